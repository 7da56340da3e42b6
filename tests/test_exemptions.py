"""Claims of exemptions stay where their documents are."""

from attestra.operators import verdicts


def test_documents_are_not_dealt_by_article(spark):
    claims = spark.createDataFrame([(i, "9", "9(2)(h)" if i % 2 else "9(2)(z)", "words of the document", f"{i} words of the document") for i in range(200)], "doc_id long, article string, reference string, quote string, document string")
    known = spark.createDataFrame([("9", "9(2)(h)", "compliant", True), ("30", "30(5)", "out_of_scope", False)], "article string, reference string, effect string, ex_ante boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as planned, not as mended for a small table
    try:
        found = verdicts.exemptions(claims.repartition(8, "doc_id"), known, by=("doc_id",))
        sizes = found.rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 200 and max(sizes) < 100  # all in one task if they meet their article's catalogue there
    rows = {r.doc_id: (r.effect, r.diagnostic) for r in found.collect()}
    assert rows[1] == ("compliant", None) and rows[2] == (None, "unknown exemption")
