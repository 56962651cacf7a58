"""Word language model: a weighted backoff automaton over all training texts.

States are the empty context and every word that training has as a context; a state has an arc for each following
word that training has after it (``least`` times or more), and a failure arc to the empty context with the weight that
the arcs leave.  With absolute discounting (D from the pairs' counts of counts, n1 / (n1 + 2 n2), where all pairs are kept)

    P(w | h) = (c(h w) - D) / c(h) [arc]  +  backoff(h) * P1(w),    backoff(h) = 1 - sum of arcs (c(h w) - D) / c(h)
    P1(w) = (c(w) - D1) / N,  the unknown word has D1 * V / N

which sums to one over the V known words and the unknown one.  A text is read once, left to right, from the state of
the end token; each token adds the log of its arc or failure weight and moves to the token's own state.

The counts are as large as the corpus and are never gathered.  Texts lie in blocks (files in the shared folder) of
about a million words.  A block sends its distinct keys to the task of the key's hash range and gets the corpus
counts of just these keys back:

1. word pairs: block -> range: own count; range -> block: the corpus count where it is ``least`` or more;
2. words: block -> range: own count and the discounted arcs it was made owner of; range -> block: count and backoff sum;
3. the block has all states and arcs that its texts pass, and scores them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, base, crc_mod, durable, fresh_dir, open_store, space_words, text_bytes
from tallyline.llm.neardup import WordHashes, _mixed, _MIX

BLOCK_WORDS = 1_200_000
RANGE_BYTES = 16_000_000  # text per hash range
FOLDS, HELD_OUT = 7, 2
LEAST, DISCOUNT = 2, 0.8  # the pruned model that is the default of language_scores; the query takes all pairs
END = np.uint64(0x5E5E5E5E5E5E5E5E)  # the end token; no word has this hash by more than chance
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def spread(data: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def spread_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the hash ranges in sorted keys: ranges + 1 positions."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


class Block:
    """Texts of a block as numbers of its distinct words (by hash), each text closed by the end token."""

    def __init__(self, docs: np.ndarray, null: np.ndarray, lengths: np.ndarray, held: np.ndarray, words: np.ndarray, stream: np.ndarray):
        self.docs, self.null, self.lengths, self.held, self.words, self.stream = docs, null, lengths, held, words, stream

    @classmethod
    def of(cls, docs: list[int | None], held: list[bool], hashes: list[np.ndarray]) -> Block:
        flat = np.concatenate([x for h in hashes for x in (h, [END])]).astype(np.uint64)
        words, stream = np.unique(flat, return_inverse=True)
        lengths = np.array([len(h) + 1 for h in hashes], np.int64)
        return cls(np.array([0 if d is None else d for d in docs], np.int64), np.array([d is None for d in docs], np.uint8), lengths, np.array(held, np.uint8), words, stream.astype(np.uint32).ravel())

    def save(self) -> bytes:
        parts = [squeeze(self.docs), squeeze(self.null), squeeze(self.lengths), squeeze(self.held), squeeze_sorted(self.words), squeeze(self.stream)]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def load(cls, data: bytes) -> Block:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        kinds = (np.int64, np.uint8, np.int64, np.uint8, None, np.uint32)
        return cls(*(spread_sorted(p) if k is None else spread(p, k) for p, k in zip(parts, kinds, strict=True)))

    def in_training(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.lengths)

    def before(self) -> np.ndarray:
        """The context of each token: the token before it, at a text's start the end token."""
        end = np.searchsorted(self.words, END).astype(np.uint32)
        return np.concatenate([[end], self.stream[:-1]]).astype(np.uint32) if len(self.stream) else self.stream

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pair keys (sorted), the pair of each token, the context of each distinct pair."""
        context = self.before()
        right = self.words[self.stream]
        keys = _mixed(self.words[context] * _MIX[0] + ((right << np.uint64(29)) | (right >> np.uint64(35))))
        distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, number.ravel(), context[first]


def _sent(block: str, keys: np.ndarray, ranges: int, *values: np.ndarray) -> pa.RecordBatch:
    at = cuts(keys, ranges)
    used = [r for r in range(ranges) if at[r] < at[r + 1]]
    cols = {"part": pa.array(used, pa.int32()), "block": pa.array([block] * len(used)), "keys": pa.array([squeeze_sorted(keys[at[r] : at[r + 1]]) for r in used], pa.binary())}
    for i, v in enumerate(values):
        cols[f"v{i}"] = pa.array([squeeze(v[at[r] : at[r + 1]]) for r in used], pa.binary())
    return pa.RecordBatch.from_pydict(cols)


def _put(fs, path: str, data: bytes) -> None:
    """A file that is there whole or not at all; a task that runs again writes the same bytes."""
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(data)
    fs.move(temp, path)


def _get(fs, path: str) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read()


def discount_of(n1: float, n2: float) -> float:
    """Absolute discount from the numbers of keys seen once and twice."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def score_block(block: Block, counts: np.ndarray, arc_sums: np.ndarray, pair_counts: np.ndarray, totals: dict[str, float], discount: float) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of each text of the block.

    counts, arc_sums: per distinct word; pair_counts: per distinct pair, 0 where there is no arc.
    """
    n, v, n1, n2 = (totals[k] for k in ("n", "v", "n1", "n2"))
    starts = np.concatenate([[0], np.cumsum(block.lengths)[:-1]]).astype(np.int64)
    base_word = np.log10((counts + 1) / (n + v + 1))
    d1 = discount_of(n1, n2)
    p1 = np.where(counts > 0, counts - d1, d1 * v) / n if n else np.ones(len(counts))
    _, pair, context_of = block.pairs()
    c = counts[context_of]
    with np.errstate(divide="ignore", invalid="ignore"):
        backoff = np.where(counts > 0, 1 - arc_sums / counts, 1.0)
        arc = np.where((pair_counts > 0) & (c > 0), (pair_counts - discount) / c, 0.0)
    log = np.log10(arc[pair] + backoff[block.before()] * p1[block.stream])
    known = (counts > 0)[block.stream]
    return block.lengths, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(base_word[block.stream], starts), np.add.reduceat(log, starts)


def language_scores(docs: DataFrame, folder: str | None = None, least: int = LEAST, discount: float | None = DISCOUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Word pairs that training has fewer than ``least`` times get no arc; 1 keeps every pair.  ``discount`` None: estimated
    from the numbers of pairs seen once and twice in training.

    Null and empty texts are the end token alone; repeated rows are counted and scored each; a null doc_id is never held
    out; extra columns are not read; an empty table gives no rows.
    """
    spark = base(docs.sparkSession)
    folder = folder or fresh_dir(spark, "language")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // RANGE_BYTES))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        hashes, k, part = WordHashes(), 0, TaskContext.get().partitionId()
        docs_, held, texts, n = [], [], [], 0

        def close():
            nonlocal docs_, held, texts, n, k
            block = Block.of(docs_, held, texts)
            name = f"{part:06d}-{k:06d}"
            fs.create_dir(root, recursive=True)
            _put(fs, f"{root}/{name}", block.save())
            keys, pair, _ = block.pairs()
            own = np.bincount(pair[block.in_training()], minlength=len(keys)).astype(np.uint32)
            docs_, held, texts, n, k = [], [], [], 0, k + 1
            return _sent(name, keys, ranges, own)

        for batch in batches:
            for doc, out, data in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), text_bytes(batch["text"]), strict=True):
                words = space_words(data)
                docs_.append(doc)
                held.append(out)
                texts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                n += len(words) + 1
                if n >= BLOCK_WORDS:
                    yield close()
        if docs_:
            yield close()

    def pair_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [spread_sorted(x) for x in pdf["keys"]]
        own = np.concatenate([spread(x, np.uint32) for x in pdf["v0"]])
        _, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(number.ravel(), weights=own).astype(np.uint64)
        kept = np.where(total >= least, total * np.uint64(2), np.uint64(0))[number.ravel()]
        kept[first] |= (kept[first] > 0).astype(np.uint64)  # the first block with the pair owns its arc
        ends = np.cumsum([len(x) for x in keys])[:-1]
        none = np.zeros(len(pdf), np.int64)
        out = pd.DataFrame({"part": pdf["part"].to_numpy(), "block": pdf["block"].to_numpy(), "values": [squeeze(x) for x in np.split(kept, ends)], "n1": none, "n2": none})
        out.loc[out.index[0], ["n1", "n2"]] = [int((total == 1).sum()), int((total == 2).sum())]
        return out

    def arcs(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = open_store(folder)
        name = pdf["block"].iloc[0]
        block = Block.load(_get(fs, f"{root}/{name}"))
        values = np.concatenate([spread(x, np.uint64) for x in pdf.sort_values("part")["values"]])
        _put(fs, f"{root}/{name}.arcs", squeeze(values >> np.uint64(1)))
        _, _, context_of = block.pairs()
        owned = (values & np.uint64(1)).astype(bool)
        sums = np.bincount(context_of[owned], weights=(values[owned] >> np.uint64(1)) - discount, minlength=len(block.words))
        own = np.bincount(block.stream[block.in_training()], minlength=len(block.words)).astype(np.uint32)
        return _sent(name, block.words, ranges, own, sums).to_pandas()

    def word_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        keys = [spread_sorted(x) for x in pdf["keys"]]
        own = np.concatenate([spread(x, np.uint32) for x in pdf["v0"]])
        sums = np.concatenate([spread(x, np.float64) for x in pdf["v1"]])
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        number = number.ravel()
        total = np.bincount(number, weights=own)
        arc = np.bincount(number, weights=sums)
        ends = np.cumsum([len(x) for x in keys])[:-1]
        none = np.zeros(len(pdf), np.int64)
        out = pd.DataFrame({
            "part": pdf["part"].to_numpy(), "block": pdf["block"].to_numpy(), "values": [squeeze(x) for x in np.split(total[number].astype(np.uint64), ends)],
            "sums": [squeeze(x) for x in np.split(arc[number], ends)], "n": none, "v": none, "n1": none, "n2": none,
        })
        out.loc[out.index[0], ["n", "v", "n1", "n2"]] = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        return out

    wide = 2 * ranges
    sent = arrow_map(slim, split, "part int, block string, keys binary, v0 binary")
    counted = durable(sent.groupBy("part").applyInPandas(pair_counts, "part int, block string, values binary, n1 long, n2 long"))
    if discount is None:
        seen = counted.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
        discount = discount_of(float(seen["n1"] or 0), float(seen["n2"] or 0))
    again = counted.select("part", "block", "values").repartition(wide, "block").groupBy("block").applyInPandas(arcs, "part int, block string, keys binary, v0 binary, v1 binary")
    words = durable(again.groupBy("part").applyInPandas(word_counts, "part int, block string, values binary, sums binary, n long, v long, n1 long, n2 long"))
    totals = {k: float(x or 0) for k, x in words.agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first().asDict().items()}

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = open_store(folder)
        name, pdf = pdf["block"].iloc[0], pdf.sort_values("part")
        block = Block.load(_get(fs, f"{root}/{name}"))
        counts = np.concatenate([spread(x, np.uint64) for x in pdf["values"]]).astype(np.float64)
        sums = np.concatenate([spread(x, np.float64) for x in pdf["sums"]])
        tokens, known, base_score, total = score_block(block, counts, sums, spread(_get(fs, f"{root}/{name}.arcs"), np.uint64).astype(np.float64), totals, discount)
        return pd.DataFrame({
            "doc_id": pd.array(np.where(block.null == 1, 0, block.docs), "Int64").copy() if not block.null.any() else pd.array([None if z else d for d, z in zip(block.docs.tolist(), block.null.tolist(), strict=True)], "Int64"),
            "held_out": block.held.astype(bool), "n_tokens": tokens, "n_known": known, "train_tokens": int(totals["n"]), "base_score": base_score, "score": total,
        })

    return words.select("part", "block", "values", "sums").repartition(wide, "block").groupBy("block").applyInPandas(score, RESULT)
