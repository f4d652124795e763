"""Phrase collocations by shard mining (SON): local support first, exact global counts of the rest.

The input partitions form a few shards. Every shard is mined completely, level by level, at the
global support divided by the number of shards, so a phrase that reaches the global support reaches
the local one in some shard. The union of locally frequent phrases travels as a filter of bounded
size, which may let others pass but stops none of them; what passes is counted exactly over all
documents, as strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import lean, scratch_table, table, whole_text
from cohortlake.llm.shingles import mix

BREAKS = b".,;:!?\n\x0b\x0c\r"
SHARDS = 4
SLICE = 2 << 20  # bytes of text looked at together, unless one text is longer
HELD = 3 << 19  # different phrases that a task holds before it hands them on
EMITTED = 1 << 16  # of them in a batch
SEGMENTS = 16  # of the filter, each built in a task of its own
MOST_BITS = 1 << 28  # of the filter: 32 MB
KNOWN_WORDS = 1 << 21  # words numbered at a time, so that three numbers fit in 63 bits
LONGEST = 3
HOT_PARTS = 1024
SALTS = 32

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(BREAKS)] = 2


def words_and_pieces(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of ``text`` as a dictionary array, and the number of the piece that holds each.

    Words are runs of other bytes than blank and tab within pieces between ``BREAKS``; A-Z are
    lower-cased. Works on whole bytes, which leaves every longer UTF-8 sequence alone.
    """
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers)
    return words.dictionary_encode(), np.searchsorted(np.flatnonzero(kind == 2), starts)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by a break) of a bounded number of bytes."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        held = 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = text.as_py()
            by_lang.setdefault(lang, []).append(body)
            held += len(body)
            if held >= SLICE:
                yield from ((k, b"\n".join(v)) for k, v in by_lang.items())
                by_lang, held = {}, 0
        yield from ((k, b"\n".join(v)) for k, v in by_lang.items())


def chained(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of a phrase from that of its first words and that of its last word."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Phrases:
    """Hashes of the words of one slice, and of its phrases by their first word's place."""

    def __init__(self, lang: str, text: bytes):
        words, piece = words_and_pieces(text)
        self.codes = words.indices.to_numpy().astype(np.int64)
        self.dictionary = words.dictionary
        salt = lang.encode()
        own = [xxhash.xxh3_64_intdigest(w, seed=len(salt)) for w in self.dictionary.to_pylist()]
        base = np.array(own, dtype=np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(salt))
        self.distinct = mix(base)
        self.words = self.distinct[self.codes]
        self.piece = piece

    def places(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words within one piece begin."""
        last = len(self.piece) - size + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[size - 1 :])

    def hashes(self, places: np.ndarray, size: int) -> np.ndarray:
        out = self.words[places]
        for k in range(1, size):
            out = chained(out, self.words[places + k])
        return out

    def likely(self, size: int, passes: dict[int, Filter]) -> np.ndarray:
        """The places of phrases whose shorter parts the filters let pass, as every frequent phrase's do."""
        places = self.places(size)
        for shorter in sorted(set(passes) & set(range(2, size))):
            for k in range(size - shorter + 1):
                places = places[passes[shorter].holds(self.hashes(places + k, shorter))]
        return places


class Filter:
    """A Bloom filter in segments; false positives only, never a miss."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # one row of bytes per segment

    @staticmethod
    def spots(hashes: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Segment, and the bits within it: (byte, mask) pairs as one number each."""
        segment = (hashes >> np.uint64(60)).astype(np.int64)
        again = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
        return segment, [((again >> np.uint64(s)) % np.uint64(width * 8)).astype(np.int64) for s in (0, 21, 42)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        segment, spots = self.spots(hashes, self.bits.shape[1])
        out = np.ones(len(hashes), dtype=bool)
        for spot in spots:
            out &= (self.bits[segment, spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
        return out


def built(frequent: DataFrame) -> Filter:
    """The filter of all hashes of ``frequent`` (h), one segment per group; its size is bounded."""
    wanted = frequent.count() * 16
    width = max(64, min(MOST_BITS, 1 << max(wanted - 1, 1).bit_length()) // SEGMENTS // 8)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, spots = Filter.spots(batch.column(0).to_numpy().view(np.uint64), width)
            for s in np.unique(segment):
                own = bits.setdefault(int(s), np.zeros(width, dtype=np.uint8))
                for spot in spots:
                    at = spot[segment == s]
                    np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = sorted(bits)
        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([bits[s].tobytes() for s in parts], pa.binary())], names=["segment", "bits"])

    dealt = frequent.repartition(SEGMENTS, F.shiftrightunsigned("h", 60))
    out = np.zeros((SEGMENTS, width), dtype=np.uint8)
    for row in dealt.mapInArrow(lean(fill), "segment int, bits binary").collect():
        out[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Filter(out)


class Tally:
    """Counts of integers, sorted and merged as they come; handed on whole when too many are held."""

    def __init__(self, emit: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]):
        self.emit = emit
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        keys, counts = np.unique(keys, return_counts=True)
        self.keys = self.keys.astype(keys.dtype, copy=False)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        self.counts[at[~new]] += counts[~new]
        # One array after the other, so that only one of them is held twice.
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.counts = np.insert(self.counts, at[new], counts[new])
        if len(self.keys) >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        keys, counts = self.keys, self.counts
        self.clear()
        for at in range(0, len(keys), EMITTED):
            yield self.emit(keys[at : at + EMITTED], counts[at : at + EMITTED])


def locally_frequent(texts: DataFrame, sizes: list[int], passes: dict[int, Filter], least: int, shards: int) -> DataFrame:
    """(h, size): hashes of phrases that reach their share of the support in some shard.

    A shard is a fixed set of input partitions, mined completely: each of its tasks counts all
    phrases whose shorter parts may be frequent, and a keyed sum adds up its tasks.
    """
    support = -(-least // shards)
    shared = texts.sparkSession.sparkContext.broadcast({k: f.bits for k, f in passes.items()})

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        filters = {k: Filter(bits) for k, bits in shared.value.items()}

        def rows(size: int):
            return lambda keys, counts: pa.record_batch(
                [
                    pa.array(np.full(len(keys), shard * (LONGEST + 1) + size, dtype=np.int8)),
                    pa.array(keys.view(np.int64)),
                    pa.array(np.minimum(counts, support).astype(np.int32)),
                ],
                names=["place", "h", "n"],
            )

        tallies = {size: Tally(rows(size)) for size in sizes}
        for lang, text in slices(batches):
            phrases = Phrases(lang, text)
            for size, tally in tallies.items():
                yield from tally.add(phrases.hashes(phrases.likely(size, filters), size))
        for tally in tallies.values():
            yield from tally.flush()

    mined = texts.mapInArrow(lean(mine), "place byte, h long, n int")
    often = mined.groupBy("place", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    return often.select("h", (F.col("place") % (LONGEST + 1)).cast("int").alias("size")).distinct()


def exact_counts(texts: DataFrame, passes: dict[int, Filter], longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of 1 to ``longest`` words that occur ``least`` times.

    Phrases that the filters stop are rare and left out at once; the rest is counted as strings.
    Within a task words are numbered, so no hash decides about equality.
    """
    shared = texts.sparkSession.sparkContext.broadcast({k: f.bits for k, f in passes.items()})
    schema = "lang string, phrase binary, size int, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: Filter(bits) for k, bits in shared.value.items()}
        numbers: dict[str, dict[bytes, int]] = {}
        names: dict[str, list[bytes]] = {}
        tallies: dict[tuple[str, int], Tally] = {}

        def rows(lang: str, size: int):
            def emit(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
                known = names[lang]
                columns = [((keys >> (21 * k)) & (KNOWN_WORDS - 1)).tolist() for k in range(size - 1, -1, -1)]
                phrases = [b" ".join([known[i] for i in row]) for row in zip(*columns, strict=True)]
                return pa.record_batch(
                    [
                        pa.array([lang] * len(keys), pa.string()),
                        pa.array(phrases, pa.binary()),
                        pa.array(np.full(len(keys), size, dtype=np.int32)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=["lang", "phrase", "size", "n"],
                )

            return emit

        for lang, text in slices(batches):
            phrases = Phrases(lang, text)
            own = numbers.setdefault(lang, {})
            known = names.setdefault(lang, [])
            # The words of a frequent phrase are frequent; no other word takes a number.
            wanted = np.flatnonzero(filters[1].holds(phrases.distinct)) if 1 in filters else np.arange(len(phrases.distinct))
            if len(own) + len(wanted) > KNOWN_WORDS:
                for size in range(1, longest + 1):
                    if (lang, size) in tallies:
                        yield from tallies[lang, size].flush()
                own.clear()
                known.clear()
            number = np.full(len(phrases.distinct), -1, dtype=np.int64)
            for i, word in zip(wanted, phrases.dictionary.take(pa.array(wanted)).to_pylist(), strict=True):
                at = own.get(word)
                if at is None:
                    at = own[word] = len(known)
                    known.append(word)
                number[i] = at
            ids = number[phrases.codes]
            for size in range(1, longest + 1):
                places = phrases.likely(size, filters)
                for k in range(size):
                    places = places[ids[places + k] >= 0]
                if size > 1 and size in filters:
                    places = places[filters[size].holds(phrases.hashes(places, size))]
                keys = ids[places]
                for k in range(1, size):
                    keys = keys << 21 | ids[places + k]
                tally = tallies.setdefault((lang, size), Tally(rows(lang, size)))
                yield from tally.add(keys)
        for tally in tallies.values():
            yield from tally.flush()

    found = texts.mapInArrow(lean(count), schema)
    totals = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return totals.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "f")


def word_totals(texts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for lang, text in slices(batches):
            data = np.frombuffer(text, dtype=np.uint8)
            inside = _KIND[data] == 0
            sums[lang] = sums.get(lang, 0) + int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(data) and inside[0])
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "n"])

    return texts.mapInArrow(lean(count), "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def looked_up(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``parts`` (lang, part, ...) with ``f`` of each part.

    A part that very many phrases share, such as an article, would be one hot key: parts that more
    than 1 / ``HOT_PARTS`` of the rows share, which number fewer than that, are broadcast.
    """
    uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    bound = parts.count() / HOT_PARTS
    named = counts.select("lang", F.col("phrase").alias("part"), "f")
    hot = uses.filter(F.col("uses") > bound).select("lang", "part").join(named, ["lang", "part"])
    marked = parts.join(F.broadcast(hot), ["lang", "part"], "left")
    rest = marked.filter("f is null").drop("f").join(named, ["lang", "part"])
    columns = rest.columns
    return marked.filter("f is not null").select(*columns).unionByName(rest)


def cut_scores(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in exact decimals of 38 digits."""
    square = a.cast("decimal(15,0)") * a.cast("decimal(15,0)")
    top = (square * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    below = (left.cast("decimal(18,0)") * right.cast("decimal(18,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, below)


def collocations(
    docs: DataFrame,
    least: int = 10,
    longest: int = LONGEST,
    top: int = 2000,
    covered: int = 50,
    shards: int = SHARDS,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score.

    Words and pieces as ``words_and_pieces`` says; a null language is ``und``, a null text empty.
    Candidates are phrases of 2 to ``longest`` (at most 3) words with a = f(phrase) >= ``least``. The
    lowest-scoring cut of a candidate counts, ties to the shortest first part; l and r count its parts,
    n all words of the language, score is floor(1000000 a a / (l r)), exactly. A candidate inside a
    longer one with 100 f(longer) >= ``covered`` a is dropped, be the longer one dropped or not. Order:
    score, then a, both falling, then the phrase by its bytes; so there are no ties. Repeated rows
    count each time; an identifier is not needed; an empty table, and languages without a candidate,
    give no rows.

    Exact for any number of shards: words are never sampled or capped, filters only spare work.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases of 2 to {LONGEST} words are supported")
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole_text(text).cast("binary").alias("text")
    )
    passes: dict[int, Filter] = {}
    for sizes in ([1, 2], *([k] for k in range(3, longest + 1))):
        found = scratch_table(locally_frequent(texts, sizes, passes, least, shards), "frequent")
        for size in sizes:
            passes[size] = built(found.filter(F.col("size") == size).select("h"))
    counts = scratch_table(exact_counts(texts, passes, longest, least), "phrases")
    words = F.split("phrase", " ", -1)

    def part(begin: Column, length: Column) -> Column:
        return F.array_join(F.slice(words, begin, length), " ")

    phrases = counts.filter("size > 1")
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(1).alias("side"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")),
    )
    parts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", F.inline(sides))
    sided = looked_up(scratch_table(parts, "parts"), counts)
    scored = sided.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    scored = scored.withColumn("score", cut_scores(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), at -> struct(at, m))))")
    inner = phrases.filter("size > 2").withColumn("span", F.explode(spans))
    inner = inner.select("lang", part(F.col("span.at"), F.col("span.m")).alias("phrase"), "f")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)
    )
    order = [F.col("cut.score").desc(), F.col("a").desc(), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(word_totals(texts), "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(words) AS phrase FROM split
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM split
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) FROM split),
counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL
  SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = first JOIN counts y ON y.lang = c.lang AND y.phrase = rest),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS f FROM candidates WHERE size = 3
    UNION ALL
    SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.f IS NULL OR 100 * o.f < 50 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t USING (lang) WHERE rank <= 2000
"""
