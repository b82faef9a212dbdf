import unicodedata

from pyspark.sql import functions as F

from weftwork.functions import text


def plain_clean(s):
    """The rule of clean(), a step at a time."""
    import regex

    s = unicodedata.normalize("NFKD", s or "")
    s = regex.sub(r"\p{Mn}", "", s).lower().replace("&", " & ")
    s = regex.sub(r"\.(?:com|in|net|org|co|fr)(?![a-z0-9_])|www\.", " ", s)
    return " ".join(regex.sub(r"[^\p{L}\p{N}&]+", " ", s).split())


NAMES = ["A&B Co.", "www.acme.com", "Ｃａｆé  Münster", "  ", "", None, "sh0shana 1st 12b", "थोने फूड्स", "x" * 20000, "#handle_1", "The Private Limited", "O'Neil (P) Ltd", "ﬁsh .in.co", "İstanbul"]


def test_clean_matches_the_plain_rule(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, n string")
    got = {r["i"]: r["c"] for r in df.select("i", text.clean("n").alias("c")).collect()}
    for i, n in enumerate(NAMES):
        if n != "İstanbul":  # lower-casing a dotted capital adds a mark that only Java keeps apart
            assert got[i] == plain_clean(n), n


def test_golden_cases(spark):
    df = spark.createDataFrame(
        [("The Private Limited", "12, New Delhi"), ("Acme", "keralam"), ("sh0shana 1st 12b", "No. 6705, Main Street"), (None, None), ("\"\"\"ehpad Club SAS", "NA")], "business_name string, business_address string")
    rows = {r["business_name"]: r for r in text.prepare(text.add_clean(df)).withColumn("tok", text.address_tokens(F.col("ad"))).collect()}
    assert rows["The Private Limited"]["core"] == "" and rows["The Private Limited"]["legal"] == "ltd pvt"
    r = rows["The Private Limited"]
    assert r["ad"] == "12 dl" and r["nums"] == ["12"] and r["num0"] == "12"
    assert rows["Acme"]["tok"] == ["kl"] and rows["Acme"]["adc"] == "kerala" and rows["Acme"]["num0"] is None and rows["Acme"]["nums"] == []
    assert rows["sh0shana 1st 12b"]["core"] == "shoshana 1st 12b"
    assert rows[None]["nm"] == "" and rows[None]["core"] == "" and rows[None]["indic"] is False
    assert rows['"""ehpad Club SAS']["core"] == "ehpad club"
