import pytest

from keelson.llm import pieces, queries
from tests.oracle import check

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_duckdb(spark, name):
    check(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_held_out_accuracy_of_the_learned_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    language = queries.queries()["op6_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = language.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert right / n >= 0.98
    toxic = queries.queries()["op3_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    right, n = toxic.selectExpr("count_if(toxic = predicted)", "count(*)").first()
    assert right / n >= 0.97 and labels.count() > 0


def test_mixing_places_every_document(spark):
    out = queries.queries()["op2_source_mixing"](spark, SF)
    n, places, top = out.selectExpr("count(*)", "count(DISTINCT place)", "max(place)").first()
    assert n == places == top + 1 == 1000


def test_tokens_of_all_documents_come_back(spark):
    assert queries.queries()["op8_sentencepiece"](spark, SF).where("NOT restored").count() == 0


def test_ids_of_all_documents_are_those_of_sentencepiece(spark):
    rows = pieces.tokenize(spark.read.parquet(f"{SF}/documents.parquet").select("text"), check_rows=True)
    assert rows.count() == 1000 and rows.where("NOT __same").count() == 0


def test_pages_have_text(spark):
    out = queries.queries()["op1_html_extraction"](spark, SF)
    assert out.count() == 250 and out.where("text LIKE '%<p>%' OR text LIKE '%track(%'").count() == 0
