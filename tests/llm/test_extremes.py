"""Components, characters and names at the ends of their ranges."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leadwright.llm.embedding_dedup import embedding_groups
from leadwright.llm.language_id import Identifier, fit, identify, keys_of
from leadwright.llm.mixing import Mixture
from leadwright.llm.sentencepiece_codec import encode_texts


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 1e307, 1e-307, 5e-324])
def test_links_of_very_large_and_small_vectors(spark, scale):
    rows = [(1, [3 * scale, scale]), (2, [3 * scale, 1.0001 * scale]), (3, [-3 * scale, scale]), (4, [scale, 0.0]), (5, [2.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund lag auf der Matte", "de")] * 20)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "́̈"), (2, "12 !́"), (3, None), (4, "é"), (5, "\U00020020")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(asked, fit(docs)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] in ("en", "de") and got[5][0] in ("en", "de")


def test_letters_above_the_first_plane_are_kept_apart():
    letters = Identifier({}).letters
    a, b, capital = (keys_of([t], letters)[0].tolist() for t in ("\U00020020", "\U00020021", "\U00010400"))
    assert a != b and capital == keys_of(["\U00010428"], letters)[0].tolist()  # a capital and its small letter
    assert not set(a) & set(keys_of([" ", "a", " "], letters)[0].tolist()) - {0x2000200020}


def test_thousands_of_languages_make_a_small_plan(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" x")).alias("text"), (F.col("id") % 1500).cast("string").alias("lang"))
    assert len(fit(docs, sample=2).langs) > 1000


def test_clashing_names_in_mixtures_and_tokens(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}", "s", 5) for i in range(9)], "doc_id long, text string, source string, `_id` long").withColumns({n: F.col("_id") for n in ("_key", "_size", "_part", "_text_key", "_source", "_uses", "c0", "a.b")})
    texts = Mixture(docs).texts()
    assert texts.columns == [*docs.columns, "shard", "place", "from"] and {r["_uses"] for r in texts.collect()} == {5}
    told = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    assert told.columns[: len(docs.columns)] == docs.columns and {(r["_source"], r["a.b"]) for r in told.collect()} == {(5, 5)}
