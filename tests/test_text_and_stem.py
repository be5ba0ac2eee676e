from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions.stem import stemmed


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


def test_ascii_analyser(spark):
    got = one(spark, X.tokens(F.col("t")), t=("string", "The Running runners, ran in 2019 — été & café's x"))
    assert got == ["running", "runners", "ran", "2019", "caf"]
    assert one(spark, X.tokens(F.col("t")), t=("string", None)) == []
    assert one(spark, X.tokens(F.col("t"), "lower"), t=("string", "The Kelvin x")) == ["kelvin", "x"]


def test_porter(spark):
    pairs = (
        "caresses caress,ponies poni,cats cat,agreed agre,feed feed,plastered plaster,bled bled,motoring motor,sing sing,sized size,hopping hop,"
        "falling fall,filing file,happy happi,sky sky,relational relat,conditional condit,triplicate triplic,hopefulness hope,goodness good,"
        "revival reviv,adoption adopt,probate probat,rate rate,controll control,roll roll,is is,"
        "ties ti,caress caress,conflated conflat,troubled troubl,tanned tan,hissing hiss,fizzed fizz,failing fail,rational ration,valenci valenc,hesitanci hesit,digitizer digit,"
        "conformabli conform,radicalli radic,differentli differ,vileli vile,analogousli analog,vietnamization vietnam,predication predic,operator oper,feudalism feudal,"
        "decisiveness decis,callousness callous,formaliti formal,sensitiviti sensit,sensibiliti sensibl,formative form,formalize formal,electriciti electr,electrical electr,"
        "allowance allow,inference infer,airliner airlin,gyroscopic gyroscop,adjustable adjust,defensible defens,irritant irrit,replacement replac,adjustment adjust,dependent depend,"
        "homologou homolog,communism commun,activate activ,angulariti angular,homologous homolog,effective effect,bowdlerize bowdler,cease ceas"
    )
    want = dict(p.split() for p in pairs.split(","))
    got = {r["term"]: r["stem"] for r in stemmed(spark.createDataFrame([(w,) for w in want], "term string")).collect()}
    assert got == want


def test_expansion_filter(spark):
    items = ["ok then", "information details things here", " the capital of france", "Paris hosts the Louvre museum ", None]
    got = one(spark, X.useful_expansions(F.col("e"), F.col("d")), e=("array<string>", items), d=("string", "Paris is the capital of France"))
    assert got == ["Paris hosts the Louvre museum"]


def test_parsed_lines(spark):
    answer = "# head\n1. First item here\n- Second item\n3. ok\n\nThird plain line"
    assert one(spark, X.parsed_lines(F.col("a")), a=("string", answer)) == ["First item here", "Second item", "Third plain line"]


def test_added_sentences(spark):
    e = "A b c. This sentence is long enough. Short one. Another long sentence!"
    got = one(spark, X.added_sentences(F.col("o"), F.col("e")), o=("string", "A b c."), e=("string", e))
    assert got == ["This sentence is long enough.", "Another long sentence!"]
    assert one(spark, X.added_sentences(F.col("o"), F.col("e")), o=("string", "Z"), e=("string", e)) == []


def test_join_and_prompts(spark):
    assert one(spark, X.joined(F.col("d"), F.col("e")), d=("string", "doc"), e=("array<string>", [])) == "doc "
    got = one(spark, X.filled(X.EXPAND_PROMPT, X.INSTRUCT, document=F.col("d"), gaps=F.lit("g")), d=("string", "text with {gaps}"))
    assert got.startswith("[INST] Generate") and "text with {gaps}" in got and got.endswith("Expansions: [/INST]".replace(": [", ": [")) 
