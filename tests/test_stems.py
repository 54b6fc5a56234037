"""Stems of English words, and searches by them."""

from pyspark.sql import functions as F

from seshat.functions import stems
from seshat.operators import fulltext
from seshat.operators.index import TextIndex

# Words and their stems by Porter's rules.
KNOWN = (
    "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled "
    "motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall "
    "hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit "
    "rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ "
    "vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal "
    "decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit "
    "sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr "
    "hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop "
    "adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend "
    "adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog "
    "effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll yes:ye "
    "by:by y:y sayings:sai generalizations:gener oscillators:oscil youth:youth toy:toi yyyy:yyyi "
)


def test_stems(spark):
    known = dict(w.split(":") for w in KNOWN.split())
    got = spark.createDataFrame([(list(known),)], "w array<string>").select(stems.stems(F.col("w"))).first()[0]
    assert dict(zip(known, got)) == known


def test_terms_of_texts(spark):
    d = spark.createDataFrame([("The Company's revenues were growing; it's the CATS' 2nd ponies",), ("",), (None,), ("a to be",), ("été 2x élan",)], "t string")
    assert [r[0] for r in d.select(stems.english("t")).collect()] == [["compani", "revenu", "were", "grow", "cat", "2nd", "poni"], [], None, [], ["t", "2x", "lan"]]


def test_searches_by_stems(spark, tmp_path):
    rows = spark.createDataFrame([(1, "growing revenues"), (2, "the sky"), (3, "a pony of the company")], "id long, content string")
    q = spark.createDataFrame([(1, "did revenue grow"), (2, "companies and ponies"), (3, "the")], "query_id long, query string")
    p = fulltext.postings(q, rows, analysed=stems.english)
    assert {(r.query_id, r.id) for r in fulltext.bm25(p, 3).collect()} == {(1, 1), (2, 3)}
    index = TextIndex(spark, str(tmp_path / "index"), 4, stems.english)
    index.upsert(rows)
    assert sorted(map(tuple, fulltext.bm25(index.postings(q), 3).collect())) == sorted(map(tuple, fulltext.bm25(p, 3).collect()))
