"""Texts that were cut off: aligned near-copies and the terminality of closing words.

A cut copy is the beginning of its original, so MinHash bands over five-word shingles
are taken of every text at doubling lengths from its start, and of the whole: a text
meets the longer ones that begin like it however much it lost. Verified pairs (the
shorter one's shingles lie in the longer one) are aligned, and a copy whose alignment
ends inside a sentence of the longer text was cut. All others are scored by how their
closing words end lines elsewhere: labels, signatures and list items end lines all
over the corpus, a cut ends on words that elsewhere go on, or on the beginning of one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkline.core import cut, source_name
from larkline.llm.ranks import rank_within

SHINGLE, BANDS, ROWS = 5, 5, 3

#: Shingles of the shortest beginning that is banded; texts of fewer words are scored by terminality alone.
FIRST = 4

#: Bits of the filters that keep what no judged text asks for out of the shuffles; joins decide afterwards.
BITS = 1 << 23

#: Words of an unfinished sentence up to which it is judged as a whole; of longer ones the last two.
OPENER = 6

# What is put behind a cut, and what closes a sentence.
MARKER = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|cut|truncated|gekürzt|abgeschnitten)[^\]\n]*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.+|…)\s*$", re.I)
CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
NUMBER_DOT = re.compile(r"(?:^|\s)\d+\.$")
DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
TRAIL = ".,;:!?"

_P = (1 << 61) - 1
_SEED = np.random.default_rng(20240611)
_A = _SEED.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64)
_B = _SEED.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def masked(word: str) -> str:
    return DIGITS.sub("9", word.lower())


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first letter of each word, in lower case."""
    words = text.lower().split()
    return np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words)), np.fromiter((ord(w[0]) for w in words), np.uint64, len(words))


def _hashes(t: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of words' hashes, in order; fewer words are one shingle; none without words."""
    if not len(t):
        return t
    n = max(1, len(t) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(t))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t[k : k + n]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles."""
    return np.unique(_hashes(_words(text)[0]))


def _lowest(h: np.ndarray, starts: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """MinHash values of the stretches of ``h`` that begin at ``starts``: one row a stretch."""
    cuts = np.union1d(starts, np.arange(0, len(h), step))
    parts = []
    for s in range(0, len(h), step):
        x = (h[s : s + step] >> np.uint64(31))[None, :] * _A[:, None] + _B[:, None]
        x ^= h[s : s + step][None, :] << np.uint64(7)
        x *= _A[::-1, None]
        x ^= x >> np.uint64(33)
        parts.append(np.minimum.reduceat(x, cuts[(cuts >= s) & (cuts < s + step)] - s, axis=1))
    return np.minimum.reduceat(np.concatenate(parts, 1), np.searchsorted(cuts, starts), axis=1).T


def bands(hashes: list[np.ndarray]) -> list[tuple[list[int], list[int]]]:
    """Of each text, given by its shingles' hashes in order, the keys of its MinHash bands, and those under which it looks for its original.

    Bands are taken of the first 4, 8, 16 and so on shingles and of all. A cut copy asks with its
    longest beginning, which its original has too, and with its whole.
    """
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(hashes)
    has = [i for i, h in enumerate(hashes) if len(h) >= FIRST]
    if not has:
        return out
    n = np.array([len(hashes[i]) for i in has])
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    # A text's stretches: 0, 4, 8, 16 ...; the one behind its last whole beginning may be empty.
    steps = np.log2(n // FIRST).astype(int) + 1  # beginnings of the text
    steps += (FIRST << steps) <= n
    steps -= (FIRST << (steps - 1)) > n
    low = np.full((len(has), steps.max() + 1, BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    edge = np.concatenate(([0], FIRST << np.arange(steps.max() + 1)))
    text, scale = np.nonzero((np.arange(steps.max() + 1)[None, :] <= steps[:, None]) & (edge[: steps.max() + 1][None, :] < n[:, None]))
    low[text, scale] = _lowest(np.concatenate([hashes[i] for i in has]), begin[text] + edge[scale])
    low = np.minimum.accumulate(low, 1).reshape(len(has), -1, BANDS, ROWS)
    size = np.where(np.arange(low.shape[1])[None, :] < steps[:, None], edge[1 : low.shape[1] + 1][None, :], 0).astype(np.uint64)
    key = size[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[:, :, :, k]) * np.uint64(0x100000001B3)
        key ^= key >> np.uint64(31)
    key = key.astype(np.int64)
    for j, i in enumerate(has):
        own = key[j, : steps[j] + 1]
        ask = [s for s in range(steps[j]) if edge[s + 1] < n[j]][-1:] + [steps[j]]
        out[i] = own.ravel().tolist(), own[ask].ravel().tolist()
    return out


def windows(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row and the first letter of the fourth, from hashes and first letters of the words."""
    if len(a) < 4:
        return np.zeros(0, np.int64)
    h = a[:-3] * np.uint64(0x9E3779B97F4A7C15) + a[1:-2]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + a[2:-1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + first[3:]
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def marks(h: np.ndarray) -> list[int]:
    """The windows as a bit set of twelve bits a window: what is not in it, the text does not hold."""
    if not len(h):
        return []
    size = 64 * -(-len(h) * 12 // 64)
    bits = np.zeros(size, np.uint8)
    bits[h % size], bits[(h >> 20) % size] = 1, 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def may_hold(bits: str, window: str) -> Column:
    """Whether the bit set of ``marks`` may hold the window."""
    size = F.greatest(F.size(bits), F.lit(1)).cast("long") * 64

    def bit(h: Column) -> Column:
        at = F.pmod(h, size)
        return F.call_function("getbit", F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

    return F.coalesce(bit(F.col(window)) & bit(F.shiftright(window, 20)), F.lit(False))


def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _grown(h: int, word: int) -> int:
    """Hash of an unfinished sentence with one more word."""
    return ((h ^ word) * 0x100000001B3 + 0x9E3779B9) & 0x7FFFFFFFFFFFFFFF


def unmarked(text: str) -> str:
    """The text without a cut mark at its end."""
    t = text.rstrip()
    return MARKER.sub("", t) if t.endswith(("]", ")", "...", "…")) else t


def closing(text: str) -> tuple[str, str | None, str | None, int | None]:
    """How a text ends: kind, the masked last two words of its unfinished sentence, the hash of all of it.

    Kinds: empty, closed (a sentence's end), marked (a cut mark inside a sentence), number (a
    number and a point, perhaps cut inside a decimal), open (anything else). A sentence of one word
    has ``^`` before it; of more than ``OPENER`` words there is no hash of the whole.
    """
    t = text.rstrip()
    if not t:
        return "empty", None, None, None
    m = unmarked(t)
    if m != t:
        t = m.rstrip()
        return ("marked" if t and not CLOSED.search(t) else "closed"), None, None, None
    closed = bool(CLOSED.search(t))
    if closed and not NUMBER_DOT.search(t):
        return "closed", None, None, None
    words = [masked(w.rstrip(TRAIL) or w) for w in SENTENCE.split(t[t.rfind("\n") + 1 :])[-1].split()]
    whole = None
    if len(words) <= OPENER:
        whole = 0
        for w in words:
            whole = _grown(whole, _word_hash(w))
    return ("number" if closed else "open"), words[-2] if len(words) > 1 else "^", words[-1], whole


def bit_filter(keys: DataFrame, key: str) -> bytes:
    """One byte for each of ``BITS`` places, 1 where a key falls; its size does not depend on the data."""
    at = F.pmod(F.col(key), F.lit(BITS))
    words = keys.filter(F.col(key).isNotNull()).groupBy(F.floor(at / 64).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("x"))
    got = words.toArrow()
    full = np.zeros(BITS // 64, np.int64)
    full[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return np.unpackbits(full.view(np.uint8), bitorder="little").tobytes()


def word_ends(documents: DataFrame, asked: bytes | None = None, text: str = "text", flush: int = 200_000) -> DataFrame:
    """How often each word pair, and each beginning of a sentence, goes on, closes a sentence, or bare a line.

    Columns: before, word, seg, on, shut, bare; pairs have no seg, beginnings (up to ``OPENER``
    words) no words. Only what ``asked`` may hold is returned. Counted per partition before anything
    is shuffled. The bare ends of whole texts are left out: those are what is judged.
    """
    asked = asked or b"\1" * BITS

    def count(batches):
        seen: dict = {}
        cache: dict[str, tuple[str, bool, int, int]] = {}
        start = asked[_word_hash("^") % BITS]

        def out():
            keys = list(seen)
            cols = [pa.array([None if type(k) is int else k[i] for k in keys], pa.string()) for i in (0, 1)]
            cols.append(pa.array([k if type(k) is int else None for k in keys], pa.int64()))
            cols += [pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays(cols, names=["before", "word", "seg", "on", "shut", "bare"])

        for b in batches:
            parts: Counter[tuple[str, int]] = Counter()
            for t in b.column(0).to_pylist():
                lines = t.rstrip().split("\n")
                for k, line in enumerate(lines):
                    sentences = SENTENCE.split(line)
                    last = len(sentences) - 1
                    for i, x in enumerate(sentences):
                        parts[x, 0 if i < last else 1 if k < len(lines) - 1 else 2] += 1
            for (sentence, end), n in parts.items():
                before, asks, whole = "^", start, 0
                words = sentence.split()
                final = len(words) - 1
                for i, w in enumerate(words):
                    got = cache.get(w)
                    if got is None:
                        if len(cache) > flush:
                            cache.clear()
                        m = masked(w.rstrip(TRAIL) or w)
                        h = _word_hash(m)
                        got = cache[w] = (m, w[-1] in TRAIL and w[-1] != ":", h, asked[h % BITS])
                    word, shut, h, ask = got
                    if i < OPENER:
                        whole = _grown(whole, h)
                    if not (i == final and end == 2 and not shut):
                        how = 1 if shut else 2 if i == final and end else 0
                        if asks:
                            c = seen.get((before, word))
                            if c is None:
                                c = seen[before, word] = [0, 0, 0]
                            c[how] += n
                        if i < OPENER and asked[whole % BITS]:
                            c = seen.get(whole)
                            if c is None:
                                c = seen[whole] = [0, 0, 0]
                            c[how] += n
                    before, asks = word, ask
            if len(seen) > flush:
                yield out()
                seen.clear()
        yield out()

    rows = documents.select(text).filter(F.col(text).isNotNull())
    found = rows.mapInArrow(count, "before string, word string, seg long, on long, shut long, bare long")
    return found.groupBy("before", "word", "seg").agg(*[F.sum(c).alias(c) for c in ("on", "shut", "bare")])


def ends_early(short: str, long: str, least: float = 0.8) -> bool:
    """The long text holds the short one, whose alignment stops inside a sentence of the long one.

    Held: at least ``least`` of the short text's shingles, without the one at its cut, are in the long one.
    """
    t = unmarked(short)
    at = [m.span() for m in re.finditer(r"\S+", t)]
    if len(at) <= SHINGLE:
        return False
    tail = [t[i:j] for i, j in at[-4:]]
    if not all(w in long for w in tail):
        return False
    full = re.compile(r"(?<!\S)(?=(" + r"\s+".join(map(re.escape, tail[:3])) + r"\s+" + re.escape(tail[3]) + "))")
    if not full.search(long):
        return False
    a, b = shingles(t[: at[-2][1]]), shingles(long)
    if len(np.intersect1d(a, b, assume_unique=True)) < least * len(a):
        return False
    before, best, stop = t.split()[-2::-1], (-1, 0), 0
    for m in full.finditer(long):
        # The occurrence that the words before it share furthest back with the short text.
        run = 0
        for x, y in zip(before, long[: m.end(1)].split()[-2::-1]):  # noqa: B905
            if x != y:
                break
            run += 1
        if (run, -abs(m.end(1) - len(t))) > best:
            best, stop = (run, -abs(m.end(1) - len(t))), m.end(1)
    rest = long[stop:]
    if not stop or not rest.strip():
        return False
    if re.match(r"[^\W_]", rest):
        return True  # inside a word
    return not (CLOSED.search(long[:stop]) or re.match(r"\s*\n", rest))


def _aligned(sketches: DataFrame, texts: DataFrame, first: int = 64) -> DataFrame:
    """Ids of texts that a longer near-copy shows to be cut: id.

    ``sketches``: id, n (length), keys, ask, tail (the window at the end, the last word by its first
    letter), bits (of all windows); ``texts``: id, text; ids are those of texts, so exact copies have
    one. A pair goes on to its texts only where the longer one may hold the shorter one's last window. Members of a bucket are numbered, whatever its size, by salted ranks; those that
    ask meet the first ``first`` of them, then eight times as many of the next, until they are found
    cut or have met all: only hot buckets of texts that begin alike and are not cut take more rounds.
    """
    asks = cut(sketches.filter(F.size("ask") > 0).select("id", "n", "tail", F.explode("ask").alias("key")).distinct())
    wanted = bit_filter(asks, "key")

    def members(batches):
        flags = np.frombuffer(wanted, np.uint8)
        for b in batches:
            keys = b.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(flags[flat % BITS])
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), b.column("id").take(at), b.column("n").take(at)], names=["key", "other", "more"])

    known = sketches.select("id", "n", "keys").filter(F.size("keys") > 0).mapInArrow(members, "key long, other long, more long").distinct()
    known = known.join(asks.select("key").distinct(), "key", "left_semi")
    longer = cut(rank_within(known, ["key"], [F.desc("more"), F.col("other")], F.xxhash64("other"), "place"))
    t, bits = texts.select("id", "text"), sketches.select(F.col("id").alias("other"), "bits")

    def judge(batches):
        for b in batches:
            hit = [ends_early(x, y) for x, y in zip(b.column("short").to_pylist(), b.column("long").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(hit, pa.bool_()))], names=["id"])

    most = longer.agg(F.max("place")).first()[0]
    waiting, found, lo, hi = asks, None, 0, first - 1
    while most is not None and lo <= most:
        some = longer.filter(F.col("place").between(lo, hi)).drop("place")
        pairs = waiting.join(some, "key").filter(F.col("n") < F.col("more")).select("id", "other", "tail").distinct()
        pairs = cut(pairs.join(bits, "other").filter(may_hold("bits", "tail")).select("id", "other").distinct())
        need = pairs.select("id").union(pairs.select("other")).distinct()
        have = t.join(need, "id", "left_semi").dropDuplicates(["id"])
        both = pairs.join(have.withColumnRenamed("text", "short"), "id").join(have.select(F.col("id").alias("other"), F.col("text").alias("long")), "other")
        hit = cut(both.select("id", "short", "long").mapInArrow(judge, "id long").distinct())
        found = hit if found is None else found.union(hit)
        waiting = waiting.join(hit, "id", "left_anti")
        lo, hi = hi + 1, hi + 8 * (hi - lo + 1)
    return sketches.select("id").limit(0) if found is None else found


def _share(end: Column, total: Column, prior: float, usual: Column) -> Column:
    return (end + prior * usual) / (total + prior)


def truncated_documents(
    documents: DataFrame, id_col: str = "doc_id", text: str = "text", min_terminality: float = 0.4, max_fragment: float = 0.8, prior: float = 2.0
) -> DataFrame:
    """Every document with how it ends: ``id_col``, is_cut, reason, terminality.

    reason is ``copy_ends_early``, ``cut_mark``, ``fragment`` (the last word is the beginning of
    what usually follows), ``open_end`` (its closing words rarely end a line), or null where the
    text is whole. Terminality is bare ends over all occurrences: of the unfinished sentence as a
    whole among the other texts, as far as they hold it, and of its two closing words.

    Defined cases: null, empty and blank texts are not cut; whole texts of any length are read;
    exact copies get the same answer and count once as evidence; ids may repeat or be null, each
    row is answered; other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).withColumn("id", F.xxhash64("text", F.length("text")))
    kind = dict(docs.dtypes)["doc"]

    def read(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ends = [closing(t) for t in texts]
            words = [_words(unmarked(t)) for t in texts]
            keys = bands([_hashes(a) for a, _ in words])
            asks = [k[1] if e[0] in ("open", "number") else [] for k, e in zip(keys, ends, strict=True)]
            seen = [windows(*w) for w in words]
            tails = [int(h[-1]) if a and len(h) else None for h, a in zip(seen, asks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc"), b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([k[0] for k in keys], pa.list_(pa.int64())),
                    pa.array(asks, pa.list_(pa.int64())), *(pa.array([e[i] for e in ends], pa.string()) for i in range(3)),
                    pa.array([e[3] for e in ends], pa.int64()), pa.array([None if e[1] is None else _word_hash(e[1]) for e in ends], pa.int64()),
                    pa.array(tails, pa.int64()), pa.array([marks(h) for h in seen], pa.list_(pa.int64())),
                ],
                names=["doc", "id", "n", "keys", "ask", "kind", "before", "word", "seg", "bh", "tail", "bits"],
            )

    schema = f"doc {kind}, id long, n long, keys array<long>, ask array<long>, kind string, before string, word string, seg long, bh long, tail long, bits array<long>"
    closers = cut(docs.mapInArrow(read, schema))
    early = _aligned(closers, docs).withColumn("early", F.lit(True))
    unsure = closers.filter(F.col("kind").isin("open", "number")).select("id", "kind", "before", "word", "seg", "bh").distinct()
    asked = bit_filter(unsure.select(F.explode(F.array("seg", "bh")).alias("key")), "key")
    ends = cut(word_ends(documents, asked, text))
    is_open = F.when(F.col("kind") == "open", 1)
    judged = unsure.groupBy("before", "word").agg(F.count(is_open).alias("own"))
    pairs = ends.filter("seg is null").join(judged.select("before").distinct(), "before", "left_semi")
    begun = pairs.filter(F.length("word") > 1).select(
        "before", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))")).alias("word"), F.expr("on + shut + bare").alias("c")
    )
    begun = begun.groupBy("before", "word").agg(F.sum("c").alias("more"))
    known = judged.join(pairs.drop("seg"), ["before", "word"], "left").join(begun, ["before", "word"], "left").na.fill(0)
    total = F.col("on") + F.col("shut") + F.col("bare") + F.col("own")
    scored = known.select(
        "before", "word",
        _share(F.col("bare") + F.col("own"), total, prior, F.lit(0.0)).alias("usual"),
        (F.col("more") / (F.col("more") + total)).alias("fragment"),
    )
    wholes = unsure.filter("seg is not null").groupBy("seg").agg(F.count(is_open).alias("s_own"))
    wholes = wholes.join(ends.filter("seg is not null").select("seg", F.col("on").alias("s_on"), F.col("shut").alias("s_shut"), F.col("bare").alias("s_bare")), "seg", "left").na.fill(0)
    rows = closers.select("doc", "id", "kind", "before", "word", "seg").join(scored, ["before", "word"], "left").join(wholes, "seg", "left").join(early, "id", "left")
    # Of the whole sentence the other texts' ends count, its own is what is judged.
    others = F.greatest(F.col("s_own") - is_open, F.lit(0))
    end = F.coalesce(F.col("s_bare") + others, F.lit(0))
    all_of = F.coalesce(F.col("s_on") + F.col("s_shut") + F.col("s_bare") + others, F.lit(0))
    terminality = F.when(F.col("kind") == "open", _share(end, all_of, 1.0, F.coalesce("usual", F.lit(0.0))))
    settled = (end > 1) & (terminality >= 0.5)
    reason = (
        F.when(F.col("early") & ~F.coalesce(settled, F.lit(False)), "copy_ends_early")
        .when(F.col("kind") == "marked", "cut_mark")
        .when(F.col("kind").isin("open", "number") & (F.col("fragment") > max_fragment), "fragment")
        .when((F.col("kind") == "open") & (terminality < min_terminality), "open_end")
    )
    return rows.select(F.col("doc").alias(id_col), reason.isNotNull().alias("is_cut"), reason.alias("reason"), F.round(terminality, 6).alias("terminality"))


def cut_rates(documents: DataFrame, id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Documents, cut ones and their share per source; a missing source is its own group."""
    text = options.pop("text", "text")
    # The source travels with the id, so rows whose ids repeat or are null keep their own.
    both = documents.select(F.struct(F.col(id_col).alias("id"), source_name(source).alias("source")).alias("row"), F.col(text).alias("text"))
    rows = truncated_documents(both, "row", **options).select("row.source", "is_cut")
    return rows.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("is_cut").cast("long")).alias("cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("cut_share")
    )
