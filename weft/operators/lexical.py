"""Kernels of the lexical search: texts coded in blocks, and the best chunks of many questions within a block. Blocks travel as compressed Arrow tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
#: More than rounding to 8 digits and the order of a sum can change.
SLIP = 3e-8


def pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(blocks: pa.ChunkedArray | pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in blocks]).combine_chunks()


def lists(owner: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Each of values as lists, by owner (sorted, 0 to n - 1)."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]


def flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def lengths(t: pa.Table, name: str) -> np.ndarray:
    return pc.list_value_length(t[name].combine_chunks()).to_numpy()


def counted(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of lists; owner, word's place and number of each word of a list."""
    coded = words.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    key = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy()) * n + coded.indices.to_numpy()
    pair, times = np.unique(key, return_counts=True)
    return coded.dictionary, pair // n, (pair % n).astype(np.int32), times.astype(np.int32)


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(texts, words, n, n_words): blocks of texts (id, t) and of their words with the number of texts that have them."""
    for b in batches:
        if b.num_rows:
            words, doc, code, tf = counted(b["t"])
            code_lists = lists(doc, b.num_rows, code, tf)
            texts = pa.table({"id": b["id"], "len": pc.list_value_length(b["t"]), "code": code_lists[0], "tf": code_lists[1]})
            seen = pa.table({"term": words, "df": np.bincount(code, minlength=len(words)).astype(np.int64)})
            yield pa.RecordBatch.from_pydict({"texts": [pack(texts)], "words": [pack(seen)], "n": pa.array([b.num_rows], pa.int64()), "n_words": pa.array([len(b["t"].flatten())], pa.int64())})


def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each block (words)."""
    for b in batches:
        for x in b["words"]:
            yield from unpack([x]).cast(pa.schema({"term": pa.string(), "df": pa.int64()})).to_batches()


def known_blocks(batches: Iterator[pa.RecordBatch], terms: pa.Array, mean_len: float, first: pa.Array, parts: int) -> Iterator[pa.RecordBatch]:
    """(d, texts): blocks (texts, words) with the asked words only, by their places in terms, each in so many parts. first: ids to be marked."""
    for b in batches:
        for x, y in zip(b["texts"], b["words"]):
            t = unpack([x])
            place = pc.fill_null(pc.index_in(unpack([y])["term"].combine_chunks(), value_set=terms), -1).to_numpy(zero_copy_only=False)
            no, doc = place[flat(t, "code")], np.repeat(np.arange(t.num_rows), lengths(t, "code"))
            ok = no >= 0
            got = lists(doc[ok], t.num_rows, no[ok].astype(np.int32), flat(t, "tf")[ok])
            t = pa.table({"id": t["id"], "norm": K1 * (1 - B + B * t["len"].to_numpy() / (mean_len or 1.0)), "first": pc.is_in(t["id"], value_set=first), "no": got[0], "tf": got[1]})
            d = np.arange(t.num_rows) % parts
            some = [(i, t.filter(pa.array(d == i))) for i in range(min(parts, t.num_rows))]
            yield pa.RecordBatch.from_pydict({"d": pa.array([i for i, _ in some], pa.int32()), "texts": [pack(x) for _, x in some]})


def asked_blocks(batches: Iterator[pa.RecordBatch], terms: pa.Array, idf: np.ndarray, common: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(q, asked): blocks of questions (id, t) with their words' places in terms and weights; those with the same common words are of one part."""
    for b in batches:
        if b.num_rows:
            words, who, code, times = counted(b["t"])
            no = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)[code]
            ok = no >= 0
            who, no, times = who[ok], no[ok].astype(np.int32), times[ok]
            order = np.lexsort((no, who))
            who, no, times = who[order], no[order], times[order]
            ends = np.searchsorted(who, np.arange(b.num_rows + 1))
            bag = [(no[i:j][c := common[no[i:j]]].tobytes() + times[i:j][c].tobytes()) for i, j in zip(ends, ends[1:])]
            q = np.array([zlib.crc32(x) % parts for x in bag], np.int32)
            got = lists(who, b.num_rows, no, times * idf[no], common[no])
            t = pa.table({"id": b["id"], "no": got[0], "w": got[1], "common": got[2]})
            some = [(i, t.filter(pa.array(q == i))) for i in np.unique(q).tolist()]
            yield pa.RecordBatch.from_pydict({"q": pa.array([i for i, _ in some], pa.int32()), "asked": [pack(x) for _, x in some]})


def best_of(texts: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(question_id, chunk_id, score): the k best of texts (id, norm, first, no, tf) for each question (id, no, w, common), and those as good but for rounding.

    Questions with the same common words share a sum over all texts. Other words of a question only add to it: its best are among the best of
    the shared sum and the texts with one of its other words. Without common words, weights may be negative. A question that has fewer than k
    texts of scores over 0 gets those marked as first that none of its words meets, with 0.
    """
    n, low_doc = texts.num_rows, np.flatnonzero(texts["first"].to_numpy())
    ask_no, ask_w, ask_common = (flat(asked, x) for x in ("no", "w", "common"))
    known = np.unique(ask_no)
    no, size = flat(texts, "no"), 1 + max([0, *(int(x.max()) for x in (ask_no, flat(texts, "no")) if len(x))])
    place = np.full(size, -1, np.int32)
    place[known] = np.arange(len(known))
    ask_no, at = place[ask_no], place[no]
    ok = at >= 0
    at = at[ok].astype(np.uint16 if len(known) < 65_536 else np.int32)  # short numbers are sorted in linear time
    order = np.argsort(at, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(known)))]).tolist()
    doc, tf = np.repeat(np.arange(n), lengths(texts, "no"))[ok][order], flat(texts, "tf")[ok][order]
    del at, ok, order, no
    part = tf * (K1 + 1) / (tf + texts["norm"].to_numpy()[doc])
    of = lambda j: (doc[start[j] : start[j + 1]], part[start[j] : start[j + 1]])

    bags: dict[tuple, list[int]] = {}
    ends = [0, *np.cumsum(lengths(asked, "no")).tolist()]
    for i in range(asked.num_rows):
        lo, hi = ends[i], ends[i + 1]
        c = ask_common[lo:hi]
        bags.setdefault((tuple(ask_no[lo:hi][c].tolist()), tuple(ask_w[lo:hi][c].tolist())), []).append(i)
    full: dict[int, np.ndarray] = {}
    product = np.empty(n)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for (js, ws), members in bags.items():
        base, low, top = np.zeros(n), -np.inf, np.empty(0, np.int64)
        for j, w in zip(js, ws):
            if j not in full:
                full[j] = np.zeros(n)
                full[j][of(j)[0]] = of(j)[1]
            base += np.multiply(full[j], w, out=product)
        if js:
            top, low = top_places(base, k)
        met = base[low_doc] > 0
        for i in members:
            lo, hi = ends[i], ends[i + 1]
            more = [(*of(j), w) for j, w, c in zip(ask_no[lo:hi].tolist(), ask_w[lo:hi].tolist(), ask_common[lo:hi].tolist()) if not c]
            before = [base[d] for d, _, _ in more]
            for d, x, w in more:
                base[d] += x * w
            ids = np.unique(np.concatenate([top, *(d[base[d] >= low - SLIP] for d, _, _ in more)])) if more else top
            score = base[ids]
            for (d, _, _), x in zip(more, before):
                base[d] = x
            if len(ids) > k:
                good = score >= np.partition(score, len(ids) - k)[len(ids) - k] - SLIP
                ids, score = ids[good], score[good]
            if len(ids) < k or score.min() < SLIP:
                rest = low_doc[~met]
                rest = rest[~np.isin(rest, np.concatenate([d for d, _, _ in more]))] if more else rest
                ids, score = np.concatenate([ids, rest]), np.concatenate([score, np.zeros(len(rest))])
            out.append((i, ids, score))
    who = np.repeat(np.array([i for i, _, _ in out], np.int64), [len(ids) for _, ids, _ in out])
    ids, score = (np.concatenate([np.empty(0, t), *(x[m] for x in out)]) for m, t in ((1, np.int64), (2, np.float64)))
    return pa.table({"question_id": asked["id"].take(pa.array(who)), "chunk_id": texts["id"].take(pa.array(ids)), "score": score})


def top_places(score: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Places of the k best positive scores and of those as good but for rounding, and the least of the k; minus infinity if there are fewer."""
    rows, low = len(score) // 64, 0.0
    if rows > k:  # the k-th best of the bests of many groups is no better than the k-th best of all
        low = np.partition(score[: 64 * rows].reshape(64, rows).max(axis=0), rows - k)[rows - k]
    ids = np.flatnonzero((score >= low - SLIP) & (score > 0))
    if len(ids) < k:
        return ids, -np.inf
    low = np.partition(score[ids], len(ids) - k)[len(ids) - k]
    return ids[score[ids] >= low - SLIP], low
