"""Every operator over rows with nulls in any column and repeated rows: one result a row, none lost."""

import pytest

from emberline.llm import embed_dup, html_text, langid, lm, mixing, near_dup, packing, quality, secrets
from emberline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "the same old words are written here again and again so that a copy is a copy"
ROWS = [(1, TEXT, "en", "a", 1), (1, TEXT, "en", "a", 1), (None, TEXT, None, None, None), (None, None, None, None, None), (2, None, "en", "b", None), (3, "", None, "b", 0), (4, TEXT + " indeed", "en", None, 1), (5, "é 𝒳 \x00 \x1c end", "xx", "", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def results(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    return {
        "op1": langid.language_id(docs),
        "op2": mixing.mix(docs),
        "op3": lm.lm_score(docs),
        "op7": quality.quality(docs, labels),
        "op8": near_dup.near_duplicates(docs, 85, 100),
        "op9": secrets.secret_scan(docs),
    }


def test_one_row_each(docs, spark):
    want = sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    for name, out in results(docs, spark).items():
        got = sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect())
        assert got == want, name


def test_repeated_rows_agree(docs, spark):
    for name in ("op1", "op3", "op7", "op8", "op9"):
        twins = [tuple(r) for r in results(docs, spark)[name].where("doc_id = 1").collect()]
        assert len(twins) == 2 and twins[0] == twins[1], name


def test_pieces_of_all_rows(docs):
    out = packing.pack(docs, tokenizer_path()).collect()
    assert len(out) == len(ROWS) and sum(r.doc_tokens == 1 for r in out) == 3


def test_null_ids_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([(None, "<p>x"), (None, None)], "page_id long, html string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "x"]
    v = [1.0, 2.0]
    vectors = spark.createDataFrame([(None, v, 1), (7, v, 1), (7, v, 1), (3, v, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embed_dup.embedding_near_duplicates(vectors).collect())
    assert got == [(0, 0, None, False), (3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False)]
