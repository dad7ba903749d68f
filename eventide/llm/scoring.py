"""LM scoring: a bigram model by deleted interpolation, learned from the training documents.

The probability of a token after another mixes three estimates: how often it followed that token,
how often it occurs at all, and one share for every known token and one unknown. The mixture weights
depend on how often the context was seen, and are learned by expectation-maximisation on the counts
of a deleted part of the training documents, given the counts of the rest.

Counts are looked up in blocks. Documents are dealt into blocks of bounded size; a block asks for
each of its distinct n-grams once, in as many parts as the key range is cut into, with its own
counts. A part adds up what all blocks sent and answers each of them in its own order. So no shuffle
carries a row per token, a very frequent n-gram is one key per block, and the model's size, which
grows with the corpus, never meets one machine. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.store import text_or_empty
from eventide.llm.words import chunks, mix, words

# Remainders of crc32(doc_id) by 7: documents the model never sees, and the deleted part.
FOLDS, HELD_OUT_FOLD, DELETED_FOLD = 7, 2, 3
# Code points of a block, and of the text whose n-grams a part adds up.
BLOCK_CHARS, PART_CHARS = 8_000_000, 4_000_000
# Held-out counts are pooled where both estimates agree to this part of a factor of two.
RESOLUTION = 32
EM_ROUNDS = 200

_END = np.uint64(0xA0761D6478BD642F)
_MAIN, _DELETED, _HELD_OUT = 0, 1, 2
_BUCKETS = 64


def _blocks(docs: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """Documents with their block and kind, dealt out by block; and their code points."""
    text = text_or_empty()
    chars = docs.agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()[0]
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    kind = F.when(fold == HELD_OUT_FOLD, _HELD_OUT).when(fold == DELETED_FOLD, _DELETED).otherwise(_MAIN)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + chars // block_chars))
    dealt = docs.select(block.alias("block"), "doc_id", kind.alias("kind"), text.alias("text"))
    return dealt.repartition("block"), chars


class _Tokens:
    """Tokens of a block in order: each word, and an end after each document."""

    def __init__(self, table: pa.Table) -> None:
        docs, tokens = [], []
        n = 0
        for batch in table.to_batches():
            for part in chunks(batch):
                found = words(part.column("text"), lower=True)
                size = np.bincount(found.text, minlength=part.num_rows) + 1
                token = np.full(size.sum(), _END)
                token[np.arange(len(found.text)) + found.text] = found.hash
                tokens.append(token)
                docs.append(np.repeat(np.arange(n, n + part.num_rows), size))
                n += part.num_rows
        self.n_docs = n
        self.doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
        # A document begins after the end of another.
        context = np.concatenate([[_END], token[:-1]]) if len(token) else token
        keys = np.concatenate([_unigram(token), _bigram(context, token)])
        self.keys, self.at = np.unique(keys, return_inverse=True)
        self.size = len(token)

    def unigrams(self) -> np.ndarray:
        return self.at[:self.size]

    def bigrams(self) -> np.ndarray:
        return self.at[self.size:]

    def contexts(self) -> np.ndarray:
        """Where each token's context is among the keys: contexts are tokens, the first is an end."""
        own = self.unigrams()
        end = np.searchsorted(self.keys, _unigram(np.array([_END])))
        return np.concatenate([end, own[:-1]])

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents named."""
        weight = np.tile(counted[self.doc].astype(np.float64), 2)
        return np.bincount(self.at, weight, len(self.keys)).astype(np.uint32)


def _unigram(token: np.ndarray) -> np.ndarray:
    return mix(token ^ np.uint64(0xE7037ED1A0B428DB))


def _bigram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(context + np.uint64(0x8EBC6AF09C88C6E3)) * np.uint64(0x589965CC75374CC3) + token)


def _planes(values: np.ndarray) -> bytes:
    """Integers with their bytes sorted by weight, so that leading zeros compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_REQUEST = "part long, block long, keys binary, main binary, deleted binary, known binary"


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        tokens = _Tokens(table)
        kind = table.column("kind").to_numpy()
        main, deleted = tokens.counts(kind == _MAIN), tokens.counts(kind == _DELETED)
        # Which keys are unigrams.
        known = np.zeros(len(tokens.keys), np.uint8)
        known[tokens.unigrams()] = 1
        part = ((tokens.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        bounds = list(zip([0, *cuts], [*cuts, len(part)], strict=True))
        block = table.column("block")[0].as_py()
        columns = [
            [int(part[a]) for a, _ in bounds], [block] * len(bounds),
            [_planes(np.diff(tokens.keys[a:b], prepend=np.uint64(0))) for a, b in bounds],
            *[[_planes(x[a:b]) for a, b in bounds] for x in (main, deleted)],
            [known[a:b].tobytes() for a, b in bounds]]
        return pa.table(columns, names=["part", "block", "keys", "main", "deleted", "known"])

    return blocks.groupBy("block").applyInArrow(ask, _REQUEST)


_ANSWER = ("block long, part long, main binary, every binary, "
           "n_main long, n_every long, v_main long, v_every long")


def _answers(requests: DataFrame) -> DataFrame:
    """Counts for each block and part; a part's share of the totals is on one of its rows."""

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64)
                for x in table.column("keys").to_pylist()]
        own, at = np.unique(np.concatenate(keys), return_inverse=True)

        def total(column: str) -> np.ndarray:
            sent = [_from_planes(x, np.uint32) for x in table.column(column).to_pylist()]
            return np.bincount(at, np.concatenate(sent), len(own)).astype(np.int64)

        main = total("main")
        every = main + total("deleted")
        known = [np.frombuffer(x, np.uint8) for x in table.column("known").to_pylist()]
        unigram = np.zeros(len(own), bool)
        unigram[at[np.concatenate(known) > 0]] = True
        bounds = np.cumsum([0, *map(len, keys)])
        rest = [0] * (table.num_rows - 1)

        def share(x: int) -> list[int]:
            return [int(x), *rest]

        def spread(counts: np.ndarray) -> list[bytes]:
            kept = np.minimum(counts, 2**32 - 1).astype(np.uint32)[at]
            return [_planes(kept[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

        return pa.table([
            table.column("block"), table.column("part"), pa.array(spread(main)), pa.array(spread(every)),
            share(main[unigram].sum()), share(every[unigram].sum()),
            share((main[unigram] > 0).sum()), share((every[unigram] > 0).sum()),
        ], names=["block", "part", "main", "every", "n_main", "n_every", "v_main", "v_every"])

    return requests.groupBy("part").applyInArrow(answer, _ANSWER).repartition("block")


def _looked_up(table: pa.Table, column: str) -> np.ndarray:
    """The answers of all parts, in the order of the block's keys."""
    order = np.argsort(table.column("part").to_numpy())
    found = table.column(column).to_pylist()
    return np.concatenate([_from_planes(found[i], np.uint32) for i in order]).astype(np.int64)


def _estimates(tokens: _Tokens, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its share after its context, its share of all tokens, its context's bucket."""
    context = counts[tokens.contexts()]
    bigram = counts[tokens.bigrams()] / np.maximum(context, 1)
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return bigram, counts[tokens.unigrams()] / max(n, 1), np.minimum(bucket, _BUCKETS - 1)


def _bins(share: np.ndarray) -> np.ndarray:
    """-1 for nothing, else the negative binary logarithm in steps."""
    with np.errstate(divide="ignore"):
        bins = np.rint(-np.log2(np.maximum(share, 1e-300)) * RESOLUTION)
        return np.where(share > 0, bins, -1).astype(np.int32)


def _pooled(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Tokens of the deleted part, counted by bucket and by what the other documents make of them."""

    def pool(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "bigram", "unigram", "uniform", "n"]
        deleted = docs.column("kind").to_numpy() == _DELETED
        if not deleted.any() or not found.num_rows:
            return pa.table([pa.array([], pa.int32())] * 3 + [pa.array([], pa.float64()), pa.array([], pa.int64())],
                            names=names)
        tokens = _Tokens(docs)
        bigram, unigram, bucket = _estimates(
            tokens, _looked_up(found, "main"), found.column("all")[0].as_py()["n_main"])
        own = deleted[tokens.doc]
        rows, n = np.unique(np.stack([bucket[own].astype(np.int32), _bins(bigram[own]), _bins(unigram[own])]),
                            axis=1, return_counts=True)
        uniform = 1.0 / (found.column("all")[0].as_py()["v_main"] + 1)
        return pa.table([*rows, np.full(len(n), uniform), n], names=names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        pool, "bucket int, bigram int, unigram int, uniform double, n long")


def interpolation_weights(shares: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights that make events of the given shares (one row per estimate) most probable, by EM."""
    weight = np.full(len(shares), 1.0 / len(shares))
    for _ in range(rounds):
        part = weight[:, None] * shares
        new = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
        if np.abs(new - weight).max() < 1e-9:
            return new
        weight = new
    return weight


def _mixture(pooled: DataFrame) -> DataFrame:
    """(bucket, bigram, unigram, uniform) weights; pooled counts have a bounded number of rows."""

    def learn(table: pa.Table) -> pa.Table:
        def share(column: str) -> np.ndarray:
            bins = table.column(column).to_numpy()
            return np.where(bins < 0, 0.0, 2.0 ** (-bins / RESOLUTION))

        shares = np.stack([share("bigram"), share("unigram"), table.column("uniform").to_numpy()])
        weight = interpolation_weights(shares, table.column("n").to_numpy())
        return pa.table([table.column("bucket").slice(0, 1), *[[x] for x in weight]],
                        names=["bucket", "bigram", "unigram", "uniform"])

    counted = pooled.groupBy("bucket", "bigram", "unigram", "uniform").agg(F.sum("n").alias("n"))
    return counted.groupBy("bucket").applyInArrow(
        learn, "bucket int, bigram double, unigram double, uniform double")


def _weight_table(learned: list[dict] | None) -> np.ndarray:
    """Weights by bucket; a bucket without held-out counts takes those of the bucket below."""
    table = np.full((3, _BUCKETS), np.nan)
    for row in learned or ():
        table[:, row["bucket"]] = row["bigram"], row["unigram"], row["uniform"]
    last = np.full(3, 1 / 3)
    for bucket in range(_BUCKETS):
        if np.isnan(table[0, bucket]):
            table[:, bucket] = last
        last = table[:, bucket]
    # Nothing follows a context that was never seen.
    table[1:, 0] /= table[1:, 0].sum()
    table[0, 0] = 0.0
    return table


_SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def score_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS,
                    part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Tokens are words, A-Z lower-cased, and one end per document; a null text is empty, so an end
    alone. ``score`` is the base-10 logarithm of the probability of all tokens, ``base_score`` that
    by add-one unigrams, ``n_known`` counts tokens that occur in training. Documents whose fold is
    ``HELD_OUT_FOLD`` teach nothing; those without a doc_id are training documents. Repeated rows
    all count. Without a deleted part the three estimates weigh alike. An empty table gives an empty
    result. Only doc_id and text are read.
    """
    blocks, chars = _blocks(docs, block_chars)
    answers = _answers(_requests(blocks, 1 + chars // part_chars))
    totals = answers.agg(*[F.sum(c).alias(c) for c in ("n_main", "n_every", "v_main", "v_every")])
    known = answers.select("block", "part", "main", "every",
                           totals.select(F.struct("*")).scalar().alias("all"))
    learned = _mixture(_pooled(blocks, known)).agg(
        F.collect_list(F.struct("bucket", "bigram", "unigram", "uniform")).alias("weights"))
    weighted = known.withColumn("weights", learned.scalar())

    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        tokens = _Tokens(table)
        counts = _looked_up(found, "every")
        totals = found.column("all")[0].as_py()
        n, v = totals["n_every"], totals["v_every"]
        bigram, unigram, bucket = _estimates(tokens, counts, n)
        mixed = _weight_table(found.column("weights")[0].as_py())[:, bucket]
        chance = mixed[0] * bigram + mixed[1] * unigram + mixed[2] / (v + 1)
        own = counts[tokens.unigrams()]

        def by_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(tokens.doc, x, tokens.n_docs)

        base = np.log10((own + 1) / (n + (v + 1)))
        return pa.table([
            table.column("doc_id"), pa.array(table.column("kind").to_numpy() == _HELD_OUT),
            np.bincount(tokens.doc, minlength=tokens.n_docs), by_doc(own > 0).astype(np.int64),
            np.full(tokens.n_docs, n), by_doc(base), by_doc(np.log10(chance)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(weighted.groupBy("block")).applyInArrow(score, _SCORE)
