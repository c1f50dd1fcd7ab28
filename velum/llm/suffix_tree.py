"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are the words right before a token, up to ``depth`` of them; an end stands before the first word of a text. A context is
tried if it stands ``min_context`` times in the training texts, an absolute number, so the tree grows with the corpus.
Its next words are those that follow it ``MIN_NEXT`` times or more. It is kept if they diverge from the
distribution of its suffix: the log-likelihood they gain must outweigh half the logarithm of the number of tokens for each of them. A
token is scored in the state of the longest kept suffix of what stands before it:

    p(x | g) = n(g x) / (n(g) + D) + (n(g) + D - S) / (n(g) + D) * p(x | next shorter kept suffix of g)

with ``D`` different next words (of those that stand ``MIN_NEXT`` times in the corpus) and ``S`` the counts of those kept; this sums to 1. The empty context gives
``(c - d) / N`` for words seen in training (absolute discounting), and all unseen words together, as in the base score, get the rest.

Levels are grown one after another until none is kept or ``depth`` is reached. Texts are packed into blocks by bytes, numbers
of words instead of words. On each level a block asks for its different (context, next word) pairs; they are dealt by context, those of a frequent
context by pair, so no task sees more of one context than ``HOT`` tokens or a bounded share of the corpus. What is dealt are packed arrays of sorted pairs, one
row for a block and shard, and answers come back in the same order. Only what is known of the frequent contexts, at most ``HOT_KINDS`` a level, is
sent to every task. The probability in the suffix that the test compares with travels in steps of 1/20 of its logarithm.

Null and empty texts consist of the end alone and are scored as such. Repeated rows count and are scored
as often as they stand; a text of any length is one row; ids may be null or repeat. Without training
texts all is unseen, one outcome of probability 1. Other columns of the input, whatever their names, are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.session import materialize

MIN_CONTEXT, MIN_NEXT, DEPTH, ADDED = 50, 2, 2, 0.1
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Different words, and tokens, that a shard counts on average.
SHARD_WORDS, SHARD_TOKENS = 1 << 20, 4 << 20
#: A context with more tokens than this, and more than the given part of the corpus, is dealt by pairs.
HOT, HOT_KINDS = 1 << 22, 1 << 18
#: Steps a unit of the decimal logarithm in which probabilities of the suffix travel.
STEPS = 20
_ANSWER = ("block long, level int, shard int, n binary, number binary, kept binary, d binary, s binary, "
           "tokens long, kinds long, once long, twice long, made long")


def _pack(values: np.ndarray) -> bytes:
    """Numbers from zero up, in as few bytes as the greatest needs, compressed a byte position at a time."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    raw = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], width * n, "zstd", asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64)


def _pack_words(words: list[bytes]) -> bytes:
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, "zstd", asbytes=True).split(b" ") if n else [b""]


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: ids, places of their words in the block's own list (most frequent first), the list with its training counts."""
    kind = docs.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, train, parts, places, size = [], [], [], _Places({b"": 0}), 0

        def block() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            seq = np.concatenate(parts)
            order = np.argsort(-np.bincount(seq, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            seq, words = rank[seq], list(places)
            learnt = np.bincount(seq[np.repeat(np.array(train, bool), sizes)], minlength=len(words))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part << 32 | made]), "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)),
                "train": [_pack(np.array(train, np.int64))], "sizes": [_pack(sizes)], "seq": [_pack(seq)],
                "words": [_pack_words([words[i] for i in order])], "learnt": [_pack(learnt)],
                "n_words": pa.array([len(words)]), "n_tokens": pa.array([len(seq)])})

        for b in batches:
            for at in range(0, b.num_rows, 256):  # few texts as Python objects at once
                rows = b.slice(at, 256)
                for i, (learn, text) in enumerate(zip(rows.column("train").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist())):
                    if size and size + len(text) > BLOCK_BYTES:
                        yield block()
                        ids, train, parts, places, size, made = [], [], [], _Places({b"": 0}), 0, made + 1
                    words = text.lower().split()
                    parts.append(np.fromiter((*map(places.__getitem__, words), 0), np.int32, len(words) + 1))
                    ids.append(rows.column("id").slice(i, 1))
                    train.append(learn)
                    size += len(text) + 1
        if size:
            yield block()

    return docs.mapInArrow(packed, f"block long, ids array<{kind}>, train binary, sizes binary, seq binary, words binary, learnt binary, "
                                   "n_words long, n_tokens long")


def _answers(rows: list[dict]) -> pa.Table:
    fields = [f.split() for f in _ANSWER.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """Training counts of the words of each block, over all blocks, and a number for each that stands ``MIN_NEXT`` times or more."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, n = _unpack_words(row["words"]), _unpack(row["learnt"])
                order, cuts = _dealt(_word_shards(words, shards), shards)
                for j, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if z > a:
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([j], pa.int32()), "block": [row["block"]],
                            "words": [_pack_words([words[i] for i in order[a:z]])], "n": [_pack(n[order[a:z]])]})

    def counted(asks: pa.Table) -> pa.Table:
        shard = asks["shard"][0].as_py()
        names, n, sizes = [], [], []
        for words, count in zip(asks["words"], asks["n"]):
            names.append(pa.array(_unpack_words(words.as_py()), pa.binary()))
            n.append(_unpack(count.as_py()))
            sizes.append(len(n[-1]))
        where = pa.chunked_array(names).combine_chunks().dictionary_encode().indices.to_numpy()
        c = np.bincount(where, np.concatenate(n)).astype(np.int64)
        often = c >= MIN_NEXT
        number = np.where(often, np.cumsum(often) * shards + shard, 0)
        rows = [{"block": -1, "level": 0, "tokens": int(c.sum()), "kinds": int((c > 0).sum()), "once": int((c == 1).sum()), "twice": int((c == 2).sum())}]
        for block, at in zip(asks["block"].to_pylist(), np.split(where, np.cumsum(sizes)[:-1])):
            rows.append({"block": block, "level": 0, "shard": shard, "n": _pack(c[at]), "number": _pack(number[at])})
        return _answers(rows)

    asks = blocks.select("block", "words", "learnt").mapInArrow(asked, "shard int, block long, words binary, n binary")
    return asks.groupBy("shard").applyInArrow(counted, _ANSWER)


def _word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their shards, and where each shard begins and ends."""
    return np.argsort(shard, kind="stable"), np.searchsorted(np.sort(shard), np.arange(shards + 1))


def _mixed(keys: np.ndarray) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


class _Plan:
    """What all tasks share: numbers of shards, totals of the corpus, and what is known of the frequent contexts of each level."""

    def __init__(self, word_shards: int, shards: int, min_context: int, tokens: int, kinds: int, once: int, twice: int):
        self.word_shards, self.shards, self.tokens, self.kinds = word_shards, shards, tokens, kinds
        self.min_context = max(min_context, MIN_NEXT)
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        self.hot = max(HOT, tokens // HOT_KINDS)
        self.frequent: list[tuple[np.ndarray, ...]] = []  # by level: context, kept, d, s

    def keeps(self, entries: np.ndarray, s: np.ndarray, mass: np.ndarray, gain: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether contexts diverge from their suffixes by more than their next words cost."""
        rest = total - s
        with np.errstate(divide="ignore", invalid="ignore"):
            others = np.where(rest > 0, rest * np.log(rest / total / np.maximum(1 - mass, 1e-9)), 0.0)
        return (entries > 0) & (gain - s * np.log(total) + others > 0.5 * entries * np.log(max(self.tokens, 2)))


class _Level:
    """The different pairs of context and next word of a block on one level, in the order in which they are asked for."""

    def __init__(self, context: np.ndarray, word: np.ndarray, total: np.ndarray, plan: _Plan):
        self.at = np.flatnonzero(context)
        self.codes, self.first, self.inverse = np.unique(context[self.at] << 32 | word[self.at], return_index=True, return_inverse=True)
        self.total = total[self.at][self.first]
        key = np.where(self.total > plan.hot, self.codes, self.codes >> 32)
        self.order, self.cuts = _dealt(_mixed(key) % plan.shards, plan.shards)

    def shards(self) -> Iterator[tuple[int, np.ndarray]]:
        for j, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            if z > a:
                yield j, self.order[a:z]


def _replayed(block: pa.Table, answers: pa.Table, plan: _Plan):
    """The tokens of a block after the levels that have answers: sizes, training, counts, probabilities, and the level that comes next."""
    by_level: dict[int, dict[int, dict]] = {}
    for a in answers.to_pylist():
        by_level.setdefault(a["level"], {})[a["shard"]] = a
    row = {name: block[name][0].as_py() for name in ("train", "sizes", "seq", "words")}
    sizes, seq, words = _unpack(row["sizes"]), _unpack(row["seq"]), _unpack_words(row["words"])
    train = np.repeat(_unpack(row["train"]), sizes)
    c, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    order, cuts = _dealt(_word_shards(words, plan.word_shards), plan.word_shards)
    for j, a in by_level[0].items():
        c[order[cuts[j]:cuts[j + 1]]] = _unpack(a["n"])
        number[order[cuts[j]:cuts[j + 1]]] = _unpack(a["number"])
    end = words.index(b"")
    first = np.cumsum(sizes) - sizes
    p_word = np.where(c > 0, c - plan.discount, plan.discount * plan.kinds) / plan.tokens if plan.tokens else np.ones(len(c))
    word, p, c = number[seq], p_word[seq], c[seq]
    context = np.append(0, np.where(c >= plan.min_context, word, 0)[:-1])
    total = np.append(0, c[:-1])
    ends = c[sizes[0] - 1]  # every text closes with the end, and the start of a text counts as one
    context[first], total[first] = (number[end], ends) if ends >= plan.min_context else (0, 0)
    level = _Level(context, word, total, plan)
    for depth in range(1, len(plan.frequent) + 1):
        n, kept, d, s, made = (np.zeros(len(level.codes), np.int64) for _ in range(5))
        got = by_level.get(depth, {})
        for j, at in level.shards():
            a = got[j]
            n[at], made[at[n[at] >= plan.min_context]] = _unpack(a["n"]), _unpack(a["number"])
            _, where = np.unique(level.codes[at] >> 32, return_inverse=True)
            kept[at], d[at], s[at] = (_unpack(a[x])[where] for x in ("kept", "d", "s"))
        hot_context, hot_kept, hot_d, hot_s = plan.frequent[depth - 1]
        if len(hot_context):
            places = np.minimum(np.searchsorted(hot_context, level.codes >> 32), len(hot_context) - 1)
            is_hot = hot_context[places] == level.codes >> 32
            for to, known in ((kept, hot_kept), (d, hot_d), (s, hot_s)):
                to[is_hot] = known[places[is_hot]]
        entry = np.where((level.codes & 0xFFFFFFFF > 0) & (n >= MIN_NEXT), n, 0)
        divisor = np.maximum(level.total + d, 1)
        own = np.where(kept > 0, entry / divisor, 0.0)
        left = np.where(kept > 0, (level.total + d - s) / divisor, 1.0)
        p[level.at] = own[level.inverse] + left[level.inverse] * p[level.at]
        context, total = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        # Of a pair that goes on, the place behind it; a text's last pair ends with the end and has none.
        going = level.at + 1 < len(word)
        context[level.at[going] + 1], total[level.at[going] + 1] = made[level.inverse][going], n[level.inverse][going]
        context[first] = 0
        level = _Level(context, word, total, plan)
    return sizes, train, c, p, level


def _pairs(blocks: DataFrame, answers: DataFrame, plan, depth: int) -> DataFrame:
    """Answers to the pairs of level ``depth``, and rows with block -1 for the numbers of the level and its frequent contexts."""

    def asked(block: pa.Table, known: pa.Table) -> pa.Table:
        shared = plan.value
        sizes, train, _, p, level = _replayed(block, known, shared)
        n = np.bincount(level.inverse, train[level.at], len(level.codes)).astype(np.int64)
        steps = np.round(-STEPS * np.log10(np.maximum(p[level.at][level.first], 1e-300))).astype(np.int64)
        rows = {name: [] for name in ("shard", "block", "codes", "n", "steps", "total")}
        for j, at in level.shards():
            codes = level.codes[at]
            _, start = np.unique(codes >> 32, return_index=True)
            for name, value in zip(rows, (j, block["block"][0].as_py(), _pack(np.diff(codes, prepend=0)), _pack(n[at]), _pack(steps[at]), _pack(level.total[at][start]))):
                rows[name].append(value)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), kinds)})

    def counted(asks: pa.Table) -> pa.Table:
        shared = plan.value
        shard = asks["shard"][0].as_py()
        parts = [[_unpack(v) for v in asks[name].to_pylist()] for name in ("codes", "n", "steps", "total")]
        sizes = [len(x) for x in parts[0]]
        found = np.concatenate([np.cumsum(x) for x in parts[0]])
        codes, where = np.unique(found, return_inverse=True)
        n = np.bincount(where, np.concatenate(parts[1]), len(codes)).astype(np.int64)
        steps = np.zeros(len(codes), np.int64)
        steps[where] = np.concatenate(parts[2])
        contexts, start, of = np.unique(codes >> 32, return_index=True, return_inverse=True)
        total = np.zeros(len(contexts), np.int64)
        for at, t in zip(np.split(found, np.cumsum(sizes)[:-1]), parts[3]):
            total[np.searchsorted(contexts, np.unique(at >> 32))] = t
        real = codes & 0xFFFFFFFF > 0
        entry = real & (n >= MIN_NEXT)
        e = np.where(entry, n, 0)
        d, s, entries = (np.add.reduceat(x.astype(np.int64), start) for x in (real & (n > 0), e, entry))
        lower = steps / -STEPS
        mass = np.add.reduceat(np.where(entry, 10.0 ** lower, 0.0), start)
        gain = np.add.reduceat(e * (np.log(np.maximum(n, 1)) - lower * np.log(10)), start)
        hot = total > shared.hot
        kept = shared.keeps(entries, s, mass, gain, total) & ~hot
        often = real & (n >= shared.min_context)
        number = np.cumsum(often) * shared.shards + shard
        rows = [{"block": -1, "level": depth, "made": int(often.sum()), "kinds": int(kept.sum())}]
        for i in np.flatnonzero(hot):
            rows.append({"block": -2, "level": depth, "tokens": int(contexts[i]), "once": int(d[i]), "twice": int(s[i]), "kinds": int(entries[i]), "made": int(total[i]),
                         "n": np.array([mass[i], gain[i]]).tobytes()})
        for block, at in zip(asks["block"].to_pylist(), np.split(where, np.cumsum(sizes)[:-1])):
            c = np.unique(of[at])
            rows.append({"block": block, "level": depth, "shard": shard, "n": _pack(np.where(entry[at] | often[at], n[at], 0)), "number": _pack(number[at[often[at]]]),
                         "kept": _pack(kept[c]), "d": _pack(np.where(kept[c], d[c], 0)), "s": _pack(np.where(kept[c], s[c], 0))})
        return _answers(rows)

    asks = _with_answers(blocks, answers).applyInArrow(asked, "shard int, block long, codes binary, n binary, steps binary, total binary")
    return asks.groupBy("shard").applyInArrow(counted, _ANSWER)


def _with_answers(blocks: DataFrame, answers: DataFrame):
    own = answers.filter("block >= 0").select("block", "level", "shard", "n", "number", "kept", "d", "s")
    return blocks.groupBy("block").cogroup(own.groupBy("block"))


def _frequent(answers: DataFrame, plan: _Plan) -> tuple[np.ndarray, ...]:
    """What the shards know of the contexts that were dealt by pairs, put together."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = np.frombuffer(b"".join(b.column("n").to_pylist()), np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in ("tokens", "once", "twice", "kinds", "made")), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                names=["context", "d", "s", "entries", "total", "mass", "gain"])

    rows = answers.filter("block = -2").select("tokens", "once", "twice", "kinds", "made", "n")
    found = (
        rows.mapInArrow(parts, "context long, d long, s long, entries long, total long, mass double, gain double")
        .groupBy("context")
        .agg(*[F.sum(x).alias(x) for x in ("d", "s", "entries", "mass", "gain")], F.max("total").alias("total"))
        .toArrow()
    )
    context, d, s, entries, mass, gain, total = (found[x].to_numpy() for x in ("context", "d", "s", "entries", "mass", "gain", "total"))
    order = np.argsort(context)
    kept = plan.keeps(entries, s, mass, gain, np.maximum(total, 1)).astype(np.int64)
    return context[order], kept[order], d[order], s[order]


def scores(docs: DataFrame, train: Column, *, key: str = "doc_id", text: str = "text",
           min_context: int = MIN_CONTEXT, depth: int = DEPTH) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``train`` is a condition on ``docs``; null counts as false.
    """
    spark = docs.sparkSession
    blocks = materialize(_packed_blocks(docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))), "blocks")
    n_words, n_tokens = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_shards, shards = -(-n_words // SHARD_WORDS) or 1, -(-n_tokens // SHARD_TOKENS) or 1
    answers = materialize(_word_counts(blocks, word_shards), "word-answers")
    totals = answers.filter("block = -1").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "kinds", "once", "twice")]).first()
    plan = _Plan(word_shards, shards, min_context, *totals)
    texts = blocks.select("block", "ids", "train", "sizes", "seq", "words")
    for level in range(1, depth + 1):
        found = materialize(_pairs(texts.drop("ids"), answers, spark.sparkContext.broadcast(plan), level), f"answers-{level}")
        frequent = _frequent(found, plan)
        made, kept = found.filter("block = -1").agg(F.coalesce(F.sum("made"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        if not kept + frequent[1].sum():
            break
        plan.frequent.append(frequent)
        answers = answers.unionByName(found)
        if not made:
            break
    model = spark.sparkContext.broadcast(plan)

    def scored(block: pa.Table, known: pa.Table) -> pa.Table:
        shared = model.value
        sizes, _, c, p, _ = _replayed(block, known, shared)
        divisor = shared.tokens + ADDED * (shared.kinds + 1)
        sums = [np.add.reduceat(x, np.cumsum(sizes) - sizes)
                for x in ((c > 0).astype(np.int64), np.log10((c + ADDED) / divisor), np.log10(np.maximum(p, 1e-300)))]
        return pa.table({"id": block["ids"].combine_chunks().flatten(), "n_tokens": sizes, "n_known": sums[0],
                         "train_tokens": np.full(len(sizes), shared.tokens), "base_score": sums[1], "score": sums[2]})

    kind = docs.schema[key].dataType.simpleString()
    made = _with_answers(texts, answers).applyInArrow(
        scored, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("id", key)
