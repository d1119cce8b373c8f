import pytest
from pyspark.sql import functions as F

from loomshift.functions import keys, names, temporal, types, values


@pytest.mark.parametrize("text, shape", [("Ab-12", "Aa-9"), ("", ""), ("ABC", "A"), ("a1b2", "a9a9"), ("ÉÈ é", "A a"), ("+1 (555)", "+9 (9)")])
def test_value_pattern(spark, text, shape):
    assert spark.createDataFrame([(text,)], "v string").select(values.value_pattern(F.col("v"))).first()[0] == shape


@pytest.mark.parametrize(
    "given, wanted",
    [(["a@b.org"] * 4 + ["x"], "email"), (["a@b.org"] * 3 + ["x"] * 2, "text"), ([" ", None], None), (["2024-01-01"] * 3, "date"), (["0", "1"], "flag"), (["12345"], "postal_code"), (["123456789"], "integer"), (["+49 30 1234567"], "phone"), (["DE", "FR"], "country_code")],
)
def test_semantic_class(spark, given, wanted):
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert df.agg(values.semantic_class(F.col("v"))).first()[0] == wanted


@pytest.mark.parametrize("name, words", [("CUST_NM", ["cust", "nm"]), ("CustomerId", ["customer", "id"]), ("HTMLParser", ["html", "parser"]), ("addr2Line", ["addr", "2", "line"]), ("", [])])
def test_split_identifier_in_python_and_spark(spark, name, words):
    assert names.split_identifier(name) == words
    assert spark.createDataFrame([(name,)], "n string").select(names.identifier_words(F.col("n"))).first()[0] == words


def test_name_tokens():
    assert names.name_tokens("tblCUST_ADDR") == ["customer", "address"]
    assert names.name_tokens("Categories") == ["category"]
    assert names.name_tokens("CLNT_DOB") == ["customer", "birth", "date"]
    assert names.name_tokens("CustomerName", context=frozenset({"customer"})) == ["name"]
    assert names.Synonyms(more_abbreviations={"xyz": "account"}).expand("xyz") == ["account"]


@pytest.mark.parametrize(
    "source, target, level, risk",
    [
        ("int", "int", "exact", None), ("int", "bigint", "widening", None), ("bigint", "int", "risky", "overflow possible (target int)"), ("tinyint", "varchar(3)", "widening", None),
        ("money", "int", "risky", "fractional part truncated; overflow possible (target int)"), ("float", "real", "risky", "a float may not fit a real"), ("nvarchar(20)", "varchar(20)", "risky", "non-ASCII characters may be lost"),
        ("varchar(300)", "nvarchar(200)", "risky", "may truncate (source max 300)"), ("text", "nvarchar(max)", "widening", None), ("datetime2(7)", "datetime", "risky", "fractional seconds rounded to 1/300 s; dates before 1753 fail"),
        ("int", "rowversion", "incompatible", "rowversion columns are generated by the server and cannot be written"), ("uniqueidentifier", "varchar(36)", "widening", None), ("date", "varchar(9)", "risky", "may truncate (needs 10 characters)"),
    ],
)
def test_type_conversions(source, target, level, risk):
    found = types.check_types(types.parse_type(source), types.parse_type(target))
    assert (found.level, found.risk) == (level, risk)


def test_a_sample_softens_a_risk_and_keeps_its_text():
    found = types.check_types(types.parse_type("bigint"), types.parse_type("int"), types.Sampled(1000, "1", "99"))
    assert found.level == "widening" and found.risk == "overflow possible (target int) (sampled 1,000 rows fit; not proof for the full table)"
    assert types.parse_type("decimal(19,4)").text() == "decimal(19,4)" and types.parse_type("varchar(x)").text() == "varchar(1)"


def test_temporal_rounding(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:29.9996' a, timestamp'2024-01-01 00:00:30' b, timestamp'9999-12-31 23:59:59.7' c")
    row = df.select(temporal.round_to_scale(F.col("a"), 3).cast("string"), temporal.to_minute(F.col("a")).cast("string"), temporal.to_minute(F.col("b")).cast("string"), temporal.round_to_scale(F.col("c"), 0).cast("string")).first()
    assert tuple(row) == ("2024-01-01 00:00:30", "2024-01-01 00:00:00", "2024-01-01 00:01:00", "9999-12-31 23:59:59")


def test_keyset_pages_cover_a_table_once(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).cache()
    seen, last = [], None
    while True:
        page = (df if last is None else df.where(keys.keyset_after(["a", "b"], last))).orderBy("a", "b").limit(8).collect()
        if not page:
            break
        seen += [tuple(r) for r in page]
        last = list(seen[-1])
    assert seen == sorted((r.a, r.b) for r in df.collect())


@pytest.mark.parametrize("text, code", [("{", "bad_key"), ("[1]", "bad_key"), ('[{"t":"xml","v":"1"}]', "key_type"), ('[{"t":"int"}]', "key_null"), ("[]", "key_missing")])
def test_key_faults(text, code):
    with pytest.raises(keys.KeyFault) as fault:
        keys.decode_key(text, 1)
    assert fault.value.code == code


def test_key_round_trip():
    parts = [{"t": "int", "v": "42"}, {"t": "decimal", "p": 19, "c": 4, "v": "1.5000"}]
    assert keys.decode_key(keys.encode_key(parts), 2) == parts
