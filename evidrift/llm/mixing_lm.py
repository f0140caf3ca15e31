"""Language-model scores by online logistic context mixing.

A text is its blank-separated words, A-Z lower-cased, and one end. Each token is written as bits: the HEAD most frequent words, the end and an
escape have Huffman codes by their training counts. Every bit is predicted in several contexts: its code node alone, with the previous word, and with the
previous two. A context's training counts of ones and zeros stand in a table at a hash of context and node, as a state of one byte: the exact pair of counts while they
are few, else their log odds and magnitude. The state gives a predictor's stretched probability. A gated linear mix of the predictors (the gate is how much is known in the longer contexts)
gives the bit's probability; its weights learn from the bits of every token they have coded, and a second, adaptive map refines the probability by what came of like ones. Weights and map live as long as
their text, or LANE tokens of a very long one, and begin with what gradient steps over all training bits have led to, each bit predicted by counts without its own. After an escape the word follows by its
share of the training occurrences of such words, plus one, an unseen word counting as one more. So the probabilities of all next tokens sum to one, unseen words being one token. The score is the sum of the log10
probabilities; bits per byte follow from it.

The context tables grow with the corpus: a slot for every other training token, as a power of two up to 2^MAX_BITS an order, which bounds the model.

The base score is the add-one unigram model over exact token counts of the training texts.

Defined results: a null text counts as empty: one end; held-out rows teach nothing; rows that repeat a doc_id are scored each;
null ids belong to the training rows; with no training rows every token is unknown and every bit even; other columns are ignored; an
empty table gives no rows. Very long texts are worked through whole.

Plan: four narrow passes over whole texts (words, contexts, weights, scores). Word counts are summed map-side, then grouped. Context counts are gathered in arrays by tasks of about TASK training tokens, sent in blocks,
and summed block by block; only the summed states come to the driver. The model that is broadcast has a bounded size: HEAD codes, KNOWN exact word counts and the states.
The counts of rarer words, which no broadcast could hold, are joined to their occurrences by a shuffle.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Keys, forget, hash_words, mix64, most_frequent, slices, stored, text_bytes, tidy

HEAD = 1 << 17
KNOWN = 1 << 19
MAX_BITS = 22
TASK = 8_000_000
LANE = 2048
RANGE = 2_000_000
PART = 1 << 22
SLAB = 32
BLOCK = 1 << 16
GATES = 4
RATE = np.float32(0.02)
_END, _ESCAPE = 0, 1
_END_KEY = np.uint64(0x5DEECE66D1234567)
_C = np.uint64(0x9E3779B97F4A7C15)
_D, _E = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _states():
    """The states' log odds, how sure each is (GATES levels), and both with a one or a zero taken out; and the state of a pair of small counts."""
    few = 13  # pairs of counts with a sum below it have states of their own
    pairs = [(a, t - a) for t in range(few) for a in range(t + 1)]
    small = np.zeros((few, few), np.uint8)
    for i, (a, b) in enumerate(pairs):
        small[a, b] = i
    odds = lambda a, b: np.log((a + 0.3) / (b + 0.3))
    sure = lambda n: (n >= 1) * 1 + (n >= 2) + (n >= 8)
    stretch = [odds(a, b) for a, b in pairs] + [(i + 0.5) / 3 - 8 for _ in range(3) for i in range(48)]
    left = [[odds(max(a - y, 0), max(b - 1 + y, 0)) for y in (0, 1)] for a, b in pairs] + [[(i + 0.5) / 3 - 8] * 2 for _ in range(3) for i in range(48)]
    level = [sure(a + b) for a, b in pairs] + [3] * 144
    left_level = [sure(a + b - 1) for a, b in pairs] + [3] * 144
    return np.array(stretch, np.float32), np.array(level, np.uint8), np.array(left, np.float32).ravel(), np.array(left_level, np.uint8), small, len(pairs)


_STRETCH, _SURE, _LEFT, _LEFT_SURE, _SMALL, _PAIRS = _states()


def states_of(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The state of each pair of counts."""
    total = ones + zeros
    few = total < len(_SMALL)
    level = np.clip((np.log((ones + 0.3) / (zeros + 0.3)) + 8) * 3, 0, 47).astype(np.int64)
    large = _PAIRS + 48 * ((total >= 64) * 1 + (total >= 512)) + level
    return np.where(few, _SMALL[np.where(few, ones, 0), np.where(few, zeros, 0)], large).astype(np.uint8)


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's path begins (one more at the end), the nodes of all paths, and their bits."""
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, nodes = {}, {}, len(counts)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], side[x], parent[y], side[y] = nodes, 0, nodes, 1
        heapq.heappush(heap, (a + b, nodes))
        nodes += 1
    starts, path, bits = [0], [], []
    for i in range(len(counts)):
        own, x = [], i
        while x in parent:
            own.append((parent[x] - len(counts), side[x]))
            x = parent[x]
        path.extend(n for n, _ in reversed(own))
        bits.extend(s for _, s in reversed(own))
        starts.append(len(path))
    return np.array(starts), np.array(path, np.int64), np.array(bits, np.uint8)


class Coder:
    """Turns texts into bits and their context slots."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, rest: int, bits: int = 16):
        """keys, counts: the KNOWN words by falling count, of which the first HEAD have codes. ends: training texts. rest: training occurrences of words
        without a code. bits: of the slots of each context table."""
        self.words, self.counts, self.head, self.bits = Keys(keys), np.append(counts, 0).astype(np.float64), min(HEAD, len(keys)), bits
        own = np.concatenate([[ends, rest], counts[: self.head]]).astype(np.int64)
        starts, path, self.sides = huffman(own)
        self.starts, self.length, self.path = starts[:-1].astype(np.int32), np.diff(starts).astype(np.int32), path.astype(np.int32)
        nodes, times = max(1, len(own) - 1), np.repeat(own, self.length)
        self.nodes = states_of(*(np.bincount(self.path[self.sides == y], times[self.sides == y], nodes).astype(np.int64) for y in (1, 0)))
        self.mixed = mix64(np.arange(nodes, dtype=np.uint64) * _C).astype(np.uint32)

    def tokens(self, part: pa.RecordBatch):
        """The words, their places among the known words, and for all tokens: code, hashes of the two contexts, and where each row begins."""
        words, _, begins = hash_words(*text_bytes(part.column("text")))
        rows = len(begins) - 1
        place = np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(begins))
        code, key = np.full(len(words) + rows, _END, np.int32), np.full(len(words) + rows, _END_KEY)
        found = self.words.find(words)
        code[place], key[place] = np.where((found >= 0) & (found < self.head), found + 2, _ESCAPE), words
        ends = begins + np.arange(rows + 1)
        before = np.append(_END_KEY, key[:-1])
        before[ends[:-1]] = _END_KEY
        second = np.append(_END_KEY, before[:-1])
        second[ends[:-1]] = _END_KEY
        return words, found, begins, code, mix64(before ^ np.uint64(0xA5A5A5A5)).astype(np.uint32), mix64(before + second * _C).astype(np.uint32), ends

    def events(self, code: np.ndarray, one: np.ndarray, two: np.ndarray):
        """The bits of tokens: bits, nodes, slots of both contexts, and where each token's bits begin (one more at the end)."""
        n = self.length[code]
        begin = np.zeros(len(code) + 1, np.int32)
        np.cumsum(n, out=begin[1:])
        source = np.arange(begin[-1], dtype=np.int32)
        source += np.repeat(self.starts[code] - begin[:-1], n)
        node, shift = self.path[source], np.uint32(32 - self.bits)
        mixed, slots = self.mixed[node], []
        for context in (one, two):
            own = np.repeat(context, n)
            own ^= mixed
            own *= _D
            own ^= own >> np.uint32(15)
            own *= _E
            own >>= shift
            slots.append(own.view(np.int32))
        return self.sides[source], node, *slots, begin

    def ranges(self, part: pa.RecordBatch):
        """The events of runs of about RANGE bits."""
        _, _, _, code, one, two, _ = self.tokens(part)
        bits, a = np.append(0, np.cumsum(self.length[code], dtype=np.int64)), 0
        while a < len(code):
            b = max(a + 1, int(np.searchsorted(bits, bits[a] + RANGE, "right")) - 1)
            yield self.events(code[a:b], one[a:b], two[a:b])
            a = b


def _first_weights() -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate (how much is known in the second and third context) and the map that changes nothing."""
    few, many = np.array([0.0, 0.25, 0.4, 0.6]), np.array([0.0, 0.2, 0.4, 0.6])
    own = np.array([[max(0.2, 1 - few[a] - many[b]), few[a], many[b]] for a in range(GATES) for b in range(GATES)], np.float32)
    return own, (1 / (1 + np.exp(-(np.arange(33, dtype=np.float32) - 16) / 2))).astype(np.float32)


class Model:
    def __init__(self, coder: Coder, tables: list[np.ndarray], tokens: int, distinct: int, ends: int, rest: tuple[int, int]):
        """tables: the states of both contexts. rest: training occurrences of words outside the code, and how many words these are."""
        self.coder, self.tables, self.tokens, self.distinct, self.ends, self.rest = coder, tables, tokens, distinct, ends, rest
        self.first = _first_weights()

    def learn(self, part: pa.RecordBatch, weights: np.ndarray) -> int:
        """Moves the weights by what the part's bits say, each bit's own count left out of what predicts it; returns how many there were."""
        n, gates = 0, GATES * GATES
        for bits, node, one, two, _ in self.coder.ranges(part):
            own = [self.coder.nodes.take(node), self.tables[0].take(one), self.tables[1].take(two)]
            for a in range(0, len(bits), 1 << 15):
                s, y = [x[a : a + (1 << 15)] for x in own], bits[a : a + (1 << 15)]
                x = [_LEFT.take(v * np.uint16(2) + y) for v in s]
                gate = _LEFT_SURE.take(s[1]) * np.intp(GATES) + _LEFT_SURE.take(s[2])
                w = np.ascontiguousarray(weights.T, np.float32)
                dot = w[0].take(gate) * x[0]
                dot += w[1].take(gate) * x[1]
                dot += w[2].take(gate) * x[2]
                error = y - 1 / (1 + np.exp(-np.clip(dot, -8, 8)))
                step = np.stack([np.bincount(gate, error * x[k], gates) for k in range(3)], 1)
                weights += 0.05 * step / np.maximum(np.bincount(gate, minlength=gates), 64)[:, None]
                n += len(y)
        return n

    def token_scores(self, code: np.ndarray, one: np.ndarray, two: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of the code of each token. Lanes of at most LANE tokens go on one token at a time, side by side; the weights and the map of a lane
        learn from all bits of a token once it is coded."""
        n, out = np.diff(begins), np.zeros(len(code))
        count = -(-n // LANE)
        starts = np.repeat(begins[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * LANE
        lengths = np.minimum(LANE, np.repeat(begins[1:], count) - starts)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        gates, lanes = GATES * GATES, len(lengths)
        weights, refined = [np.tile(v, lanes) for v in np.ascontiguousarray(self.first[0].T)], np.tile(self.first[1], lanes)
        one_, quarter = np.float32(1), np.float32(0.25)
        for t in range(0, len(active), SLAB):
            steps = active[t : t + SLAB]
            lane = np.concatenate([np.arange(m, dtype=np.int32) for m in steps])
            tokens = starts[lane] + np.repeat(np.arange(t, t + len(steps)), steps)
            bits, node, a, b, begin = self.coder.events(code[tokens], one[tokens], two[tokens])
            n = np.diff(begin)
            a, b = self.tables[0].take(a), self.tables[1].take(b)
            x0, x1, x2 = _STRETCH.take(self.coder.nodes.take(node)), _STRETCH.take(a), _STRETCH.take(b)
            gate = _SURE.take(a) * np.int32(GATES) + _SURE.take(b)
            gate += np.repeat(lane * np.int32(gates), n)
            place0 = np.repeat(lane * np.int32(33) + np.int32(16), n)
            run = np.ones(len(bits), bool)
            np.not_equal(gate[1:], gate[:-1], out=run[1:])
            run[begin[:-1]] = True
            y, q = bits.astype(np.float32), np.empty(len(bits), np.float32)
            which, run = np.cumsum(run, dtype=np.int32), np.flatnonzero(run)
            cut = begin[np.append(0, np.cumsum(steps))]
            cuts = np.searchsorted(run, cut)
            rows = gate[run]
            for i in range(len(steps)):
                lo, hi, r0, r1 = cut[i], cut[i + 1], cuts[i], cuts[i + 1]
                own, spread, begins_ = rows[r0:r1], which[lo:hi] - which[lo], run[r0:r1] - lo
                w = [v.take(own) for v in weights]
                xs = x0[lo:hi], x1[lo:hi], x2[lo:hi]
                dot = w[0].take(spread)
                dot *= xs[0]
                for v, z in ((w[1], xs[1]), (w[2], xs[2])):
                    more = v.take(spread)
                    more *= z
                    dot += more
                np.minimum(dot, 8, out=dot)
                np.maximum(dot, -8, out=dot)
                place = np.rint(dot + dot).astype(np.int32)
                place += place0[lo:hi]
                np.negative(dot, out=dot)
                np.exp(dot, out=dot)
                dot += one_
                np.reciprocal(dot, out=dot)
                r, own_y = refined.take(place), y[lo:hi]
                q[lo:hi] = (dot * 3 + r) * quarter
                refined[place] = r + (own_y - r) * RATE
                dot -= own_y
                dot *= -RATE
                for v, old, z in zip(weights, w, xs):
                    v[own] = old + np.add.reduceat(dot * z, begins_)
            np.subtract(one_, q, out=q, where=bits == 0)
            out[tokens] = np.add.reduceat(np.log10(q, out=q), begin[:-1], dtype=np.float64) if len(q) else 0.0
        return out


_ready: dict[str, Model] = {}


def _count_words(batches):
    """word, n: summed over as much of a partition as bounded memory allows."""
    kept, held = [], 0

    def summed(parts):
        keys, group = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(group, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    for batch in batches:
        for part in slices(batch, "text"):
            kept.append(np.unique(hash_words(*text_bytes(part.column("text")))[0], return_counts=True))
            held += len(kept[-1][0])
            if held > 1_500_000:
                kept = [summed(kept)]
                held = len(kept[0][0])
                if held > 750_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1])], names=["word", "n"])
                    kept, held = [], 0
    if kept:
        keys, n = summed(kept)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])


def _count_contexts(shared):
    """table, block, counts: zeros and ones of BLOCK slots, as bytes of pairs of 32-bit numbers; blocks without any are left out."""

    def run(batches):
        coder = shared.value
        sums = [np.zeros(2 << coder.bits, np.int32) for _ in range(2)]
        for batch in batches:
            for part in slices(batch, "text", PART):
                for bits, _, *slots, _ in coder.ranges(part):
                    for total, own in zip(sums, slots):
                        np.add.at(total, own * np.intp(2) + bits, np.int32(1))
        for k, total in enumerate(sums):
            for at in range(0, len(total), 2 * BLOCK):
                own = total[at : at + 2 * BLOCK]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at // (2 * BLOCK)], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["table", "block", "counts"])

    return run


def _sum_blocks(batches):
    """The states of the blocks of a partition, summed as they come."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, block, raw in zip(*(batch.column(c).to_pylist() for c in ("table", "block", "counts"))):
            own = np.frombuffer(raw, np.int32)
            if (k, block) not in sums:
                sums[k, block] = own.astype(np.int64)
            else:
                sums[k, block] += own
    for (k, block), total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([states_of(total[1::2], total[::2]).tobytes()], pa.binary())], names=["table", "block", "states"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train(docs: DataFrame, learn: Column) -> tuple[Model, DataFrame]:
    """The model of the rows of docs for which learn holds, and the stored counts of all their words."""
    spark, rows = docs.sparkSession, _rows(docs.where(learn))
    counts = stored(rows.mapInArrow(tidy(_count_words), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    ends = rows.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    best = most_frequent(counts, "n", KNOWN).select("word", "n").toArrow()
    keys, n = best.column("word").to_numpy().astype(np.int64), best.column("n").to_numpy().astype(np.int64)
    order = np.lexsort((keys, -n))
    keys, n = keys[order].view(np.uint64), n[order]
    coder = Coder(keys, n, ends, int(total - n[:HEAD].sum()), min(MAX_BITS, max(16, (int(total) // 2).bit_length())))
    shared = spark.sparkContext.broadcast(coder)
    gathered = rows.coalesce(-(-int(total) // TASK) or 1).mapInArrow(tidy(_count_contexts(shared)), "table int, block int, counts binary")
    summed = gathered.repartition("table", "block").mapInArrow(tidy(_sum_blocks), "table int, block int, states binary").toArrow()
    tables = [np.zeros(1 << coder.bits, np.uint8) for _ in range(2)]
    for k, block, raw in zip(*(summed.column(c).to_pylist() for c in ("table", "block", "states"))):
        tables[k][block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.uint8)
    shared.unpersist()
    model = Model(coder, tables, int(total + ends), int(distinct + (ends > 0)), ends, (int(total - n[:HEAD].sum()), int(distinct - coder.head)))
    shared = spark.sparkContext.broadcast(model)

    def learnt(batches):
        own, n = shared.value, 0
        weights = own.first[0].astype(np.float64)
        for batch in batches:
            for part in slices(batch, "text", PART):
                n += own.learn(part, weights)
        if n:
            flat = np.concatenate([[n], n * weights.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)).astype(np.int32)), pa.array(flat)], names=["place", "value"])

    sums = {r.place: r.value for r in rows.mapInArrow(tidy(learnt), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    if sums.get(0):
        model.first = (np.array([sums[i] for i in range(1, len(sums))]) / sums[0]).reshape(-1, 3).astype(np.float32), model.first[1]
    shared.unpersist()
    return model, counts


_SCORED = "row_no bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, n_head bigint, base double, score double, rest array<struct<word:bigint,times:bigint>>"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    floor, low = -np.log10(model.tokens + model.distinct + 1), -np.log10(sum(model.rest) + 1)

    def run(batches):
        own = _ready.get(name)
        if own is None:
            _ready.clear()
            own = _ready[name] = shared.value
        for batch in batches:
            for part in slices(batch, "text", PART):
                words, found, begins, *tokens = own.coder.tokens(part)
                n_words, rows = np.diff(begins), part.num_rows
                row = np.repeat(np.arange(rows), n_words)
                hit = found >= 0
                plain = np.log10(own.coder.counts[found] + 1)
                base = np.bincount(row[hit], plain[hit] + floor, rows) + np.log10(own.ends + 1) + floor
                escaped = found >= own.coder.head
                coded = np.bincount(np.repeat(np.arange(rows), n_words + 1), own.token_scores(*tokens), rows)
                score = coded + np.bincount(row[escaped], plain[escaped] + low, rows)
                n_head = np.bincount(row[hit], minlength=rows) + (own.ends > 0)
                left = np.flatnonzero(~hit)
                order = left[np.lexsort((words[left], row[left]))]
                changed = np.ones(len(order), bool)
                changed[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
                heads = np.flatnonzero(changed)
                times = np.diff(np.append(heads, len(order)))
                rest = pa.StructArray.from_arrays([pa.array(words[order][heads].view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[order][heads], minlength=rows))]).astype(np.int32)
                n_bytes = np.diff(text_bytes(part.column("text"))[1])
                columns = [part.column("row_no"), part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_bytes, n_words + 1, n_head)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["row_no", "doc_id", "n_bytes", "n_tokens", "n_head", "base", "score", "rest"])

    scored = stored(_rows(docs).withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(tidy(run), _SCORED))
    rest = scored.select("row_no", F.explode("rest").alias("r")).select("row_no", "r.*").join(counts, "word", "left")
    rest = rest.groupBy("row_no").agg(F.sum("times").alias("n_rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_rest"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("log_rest"))
    out = scored.drop("rest").join(rest, "row_no", "left")
    with_rest = lambda name, each: F.col(name) + F.coalesce(F.col("log_rest") + F.col("n_rest") * F.lit(float(each)), F.lit(0.0))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_head") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), with_rest("base", floor).alias("base_score"), with_rest("score", low).alias("score"))
