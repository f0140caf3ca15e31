"""No key of a model's tables is lost, however many share their leading bits."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidrift.llm import mixing_lm
from evidrift.llm.common import Keys, crc_fold


def test_tables_hold_every_key():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 200_000, np.uint64), np.arange(50, dtype=np.uint64), np.arange((1 << 64) - 50, 1 << 64, dtype=np.uint64)]))
    rng.shuffle(keys)
    table = Keys(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(rng.integers(0, 1 << 64, 1000, np.uint64)) < 0).all() and (Keys(keys[:-60]).find(keys[-60:]) < 0).all()
    assert (Keys(keys[:0]).find(keys) < 0).all()


def test_every_word_of_a_small_vocabulary_is_coded(spark):
    texts = [" ".join(f"w{j}" for j in range(i, 20_000, 20)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    model, counts = mixing_lm.train(docs, F.lit(True))
    words = counts.toArrow().column("word").to_numpy().view(np.uint64)
    assert len(words) == 20_000 and model.rest == (0, 0)
    assert (model.coder.words.find(words) >= 0).all() and model.coder.head == 20_000


def test_probabilities_of_all_next_tokens_sum_to_one(spark):
    """Words with a code, words behind the escape, the end, and one unseen word, in a known and in an unknown context."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 60) if i < 4000) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before, mixing_lm.HEAD = mixing_lm.HEAD, 50
    try:
        model, counts = mixing_lm.train(docs, F.lit(True))
        vocabulary = sorted({w for t in texts for w in t.split()})
        assert model.coder.head == 50 < len(vocabulary)
        for prefix in ("w1 w2", "w3", "never seen"):
            rows = [prefix, *(f"{prefix} {w}" for w in [*vocabulary, "unseen!"])]
            part = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
            words, found, begins, *tokens = model.coder.tokens(part)
            logs, ends = model.token_scores(*tokens), tokens[-1]
            n = len(prefix.split())
            total = 10 ** logs[n]  # the end
            for r in range(1, len(rows)):
                own = logs[ends[r] + n]
                place = found[begins[r] + n]
                if not 0 <= place < model.coder.head:
                    own += np.log10((model.coder.counts[place] if place >= 0 else 0) + 1) - np.log10(sum(model.rest) + 1)
                total += 10**own
            assert abs(total - 1) < 1e-3
    finally:
        mixing_lm.HEAD = before


def test_a_model_of_the_corpus_beats_single_words(spark):
    """Held-out texts score higher than by their words alone, and texts that the corpus holds twice higher than those it holds once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_fold("doc_id", 7) == 2
    model, counts = mixing_lm.train(docs, ~held)
    rows = mixing_lm.score(docs.where(held), model, counts).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(np.isfinite(r.score) for r in rows)
