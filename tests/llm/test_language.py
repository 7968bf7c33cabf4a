from pyspark.sql import functions as F

from wireloom.llm import language

DATA = "/root/testdata/sf0.01"


def test_visible_text():
    page = "<html lang=de><!-- <p>no</p> --><style>a<b</style><p>Gr&uuml;&szlig;e<br>an</p><script>if (a<b) 'no'</script>alle<!-- open"
    assert language.visible(page).split() == ["Grüße", "an", "alle"]
    assert language.visible("<script" * 50_000) == ""


def test_held_out_documents_are_recognised_as_bare_pages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs.filter("doc_id % 2 = 0"))
    pages = docs.filter("doc_id % 2 = 1 AND n_chars > 100").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    judged = language.identify(pages.drop("lang"), model).join(pages.select(F.col("page_id").alias("id"), F.col("lang").alias("true")), "id")
    right = judged.agg(F.avg((F.col("lang") == F.col("true")).cast("double"))).first()[0]
    assert right > 0.97


def test_evidence_decides_where_the_text_says_nothing(spark):
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    german = "<html lang=de><p>" + spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'de' and n_chars > 500").first().text
    rows = [(i, f"http://host.example.org/de/{i}", german) for i in range(30)]
    rows += [(100, "http://host.example.org/x", ""), (101, None, None), (102, "http://other.com/", "<html lang='de-AT'>"), (103, "http://other.com/de/", "1"), (104, "u", "x" * 200_000), (None, None, ""), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'zz' AS lang", "1 AS p")
    got = {r.id: r for r in language.identify(pages, model).collect()}
    assert got[100].lang == "de" and got[102].lang == "de" and got[103].lang == "de"
    assert got[102].declared == "de" and got[103].segment == "de" and got[101].declared is None
    assert all(0 < r.posterior <= 1 for r in got.values())
    assert len(language.identify(pages, model).collect()) == len(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string, text string, lang string")
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert language.identify(none, model).count() == 0
    unlabelled = language.fit(none)
    assert unlabelled.languages == []
    one = spark.createDataFrame([(1, "http://a/", "text")], "page_id bigint, url string, html string")
    assert language.identify(one, unlabelled).first().lang is None
