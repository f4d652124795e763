import cProfile
import itertools
import pstats
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm import common, simple8b, token_store
from cohortlake.llm.token_store import WordCoder, default_vocabulary, opened, pack_segment, runs, tokenized, unpack_segment

TEXTS = [
    (5, "The quick <|endoftext|> brown\tfox!! don't  jump."),
    (2, None),
    (9, ""),
    (1, "É é ẞ İſtanbul ΣΑΣ 中文 🙂 ½ word_word $$$ ... a-b"),
    (None, "nameless"),
    (7, "same"),
    (7, "same"),
    (3, "long " * 30_000),
]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    words, offsets, escapes = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, len(values), escapes) == values).all()
    assert len(offsets) == -(-len(values) // simple8b.BLOCK)


def test_words_hold_as_many_values_as_fit():
    assert len(simple8b.encode(np.ones(600, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(1024, 49_000, np.uint64))[0]) == 342


def test_segment_round_trip():
    ids = np.arange(3000, dtype=np.uint32)
    numbers, lengths, back = unpack_segment(pack_segment([4, None, -1], [1000, 0, 2000], ids))
    assert numbers == [4, None, -1] and lengths.tolist() == [1000, 0, 2000] and (back == ids).all()
    with pytest.raises(ValueError, match="segment"):
        unpack_segment(b"\0" * 64)


def plain(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.text(st.one_of(st.sampled_from(list("aB .,!'\n\t<|>$_-é́İςſ1")), st.characters(codec="utf-8")), max_size=40), max_size=20))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, sizes = WordCoder(default_vocabulary(), bound=50).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == plain(texts)


def test_marked_pieces_take_no_calls_each():
    """Words of letters with marks behind them, in either case, are split and looked up as arrays."""
    coder = WordCoder(default_vocabulary())
    coder.encode(pa.array(["other words, 1 é."]))  # imports happen here
    words = [f"{a}{b}" for a in ("straße", "été", "Word", "TEXT", "ÿØ") for b in "abcdefghijklmnopqrst"]
    pieces = [w + x + y for w in words for x in ".,!?$%*" for y in ('"', ")", "]", "\\", "^", "--", "")]
    profile = cProfile.Profile()
    profile.enable()
    ids, sizes = coder.encode(pa.array([" ".join(pieces)]))
    profile.disable()
    assert ids.tolist() == plain([" ".join(pieces)])[0] and sizes.tolist() == [len(ids)]
    assert pstats.Stats(profile).total_calls < len(pieces) / 2


def test_letters_of_other_scripts_and_signs():
    texts = ["ª µ × ÷ º ª. µ! ×× a×b a÷ ßẞ. İ, ǅ; Слово! слово. ΣΑΣ? 中文. é.é e\u0301. ﬁ. ½. Ⅷ. ʰ. a\u200d. \u00ad.", "", "... -- a.b .a a."]
    ids, sizes = WordCoder(default_vocabulary()).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == plain(texts)


def test_a_worker_opens_its_vocabulary_once():
    first, second = WordCoder(default_vocabulary()), WordCoder(default_vocabulary())
    assert first.tokenizer is second.tokenizer


def test_words_of_latin_letters_skip_the_expressions_of_the_vocabulary():
    """Their own tokenizer gives the same ids; words of other letters do not reach it."""
    coder = WordCoder(default_vocabulary())
    words = ["".join(w) for w in itertools.product("AzÀÖØöøÿßµ", "Éeñ", ["", "THE", "ing", "ÿ"])]
    latin = [w for w in words if "µ" not in w]
    assert coder.latin.encode(" ".join(latin), add_special_tokens=False).ids == plain([" ".join(latin)])[0]
    seen = []
    coder.latin = SimpleNamespace(encode_batch_fast=lambda texts, **_: seen.extend(texts) or opened(default_vocabulary())[1].encode_batch_fast(texts, **_))
    coder.known = {"": b""}
    texts = [" ".join(words), "Слово 中文 ᄀ가 \uf900 don't ẞ x1"]
    ids, sizes = coder.encode(pa.array(texts))
    assert [ids[: sizes[0]].tolist(), ids[sizes[0] :].tolist()] == plain(texts)
    assert len(seen) == 1 and {w.lower() for w in seen[0].split()} == {w.lower() for w in latin}


@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_rows_are_coded_in_runs_of_bounded_bytes(lengths, size):
    texts = pa.array(["a" * n for n in lengths], pa.string())
    found = list(runs(texts, size))
    assert [at for at, _ in found] + [len(lengths)] * bool(found) == [0] * bool(found) + [at + n for at, n in found]
    assert sum(n for _, n in found) == len(lengths) and all(sum(lengths[at : at + n - 1]) < size for at, n in found)


def test_long_texts_are_coded_few_at_a_time(spark, monkeypatch):
    """2,000 rows at a time were 100 MB of these texts."""
    held = []

    class Spy(WordCoder):
        def encode(self, texts):
            held.append(sum(len(t) for t in texts.to_pylist()))
            return super().encode(texts)

    monkeypatch.setattr(token_store, "WordCoder", Spy)
    tasks = []
    monkeypatch.setattr(token_store, "lean", lambda run: tasks.append(run) or common.lean(run))
    monkeypatch.setattr(token_store, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    pools = []
    monkeypatch.setattr(token_store.pa, "set_memory_pool", lambda pool: pools.append(pool.backend_name))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: self)
    token_store.write_tokens(docs, token_store.shared_folder(spark) + "/long-texts", default_vocabulary())
    batch = pa.record_batch([pa.array(range(100)), pa.array(["some words " * 5000] * 100)], names=["doc_id", "text"])
    [image] = [b.column(4)[0].as_py() for b in tasks[0](iter([batch]))]
    assert unpack_segment(image)[1].tolist() == [10_001] * 100
    assert sum(held) == 100 * 55_000 and max(held) < token_store.CODED_BYTES + 55_000
    assert pools == ["system"]


def test_store(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(4)
    got = sorted((tuple(r) for r in tokenized(df, default_vocabulary()).collect()), key=lambda r: r[1])
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, wanted = 0, []
    for (i, _), ids in zip(ordered, plain([t or "" for _, t in ordered]), strict=True):
        coded = np.array([*ids, 1], dtype="<u4")
        wanted.append((i, start, len(coded), zlib.crc32(coded.tobytes())))
        start += len(coded)
    assert got == wanted


def test_empty_store(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenized(df, default_vocabulary()).collect() == []


def test_coding_tasks_give_their_memory_back(spark, monkeypatch):
    lean = []
    monkeypatch.setattr(token_store, "lean", lambda run: lean.append(run.__name__) or common.lean(run))
    df = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert tokenized(df, default_vocabulary()).count() == 1
    assert lean == ["encode", "decode"]
