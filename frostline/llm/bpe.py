"""Byte-level BPE by the ranks of a vocabulary file, and back.

Pieces come from ``pretokens``; each distinct piece is merged once per task and kept in a
bounded cache. Documents carry the ends of their pieces in ids, so that any piece can be
decoded by itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frostline.functions.names import free_name
from frostline.llm.common import refuse_names, text_slices, whole_text
from frostline.llm.pretokens import Pieces

CACHE_PIECES = 300_000
BATCH_CHARS = 500_000


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


SHORT_PIECE = 32  # bytes up to which pieces are merged side by side in one array


class Merger:
    """Merges pieces by rank: the pair of lowest rank first, the leftmost among equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values(), default=0) + 1
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.merged = np.array([r for _, r in pairs] + [self.none], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], self.none)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > SHORT_PIECE:
                out[i] = np.array(self.long(piece), "<u4").tobytes()
            else:
                widths.setdefault((len(piece) + 3) // 4 * 4, []).append(i)
        for width, own in widths.items():
            self._side_by_side(pieces, own, width, out)
        return out

    def _side_by_side(self, pieces: list[bytes], left: list[int], width: int, out: list[bytes]) -> None:
        columns = np.arange(width)
        lengths = np.array([len(pieces[i]) for i in left])
        ids = np.full((len(left), width + 1), -1, np.int32)
        inside = columns < lengths[:, None]
        ids[:, :width][inside] = self.single[np.frombuffer(b"".join(pieces[i] for i in left), np.uint8)]
        pair = np.full((len(left), width), self.none, np.int32)
        both = columns + 1 < lengths[:, None]
        pair[both] = self.pair_ranks(ids[:, :width][both], ids[:, 1:][both])
        left = np.array(left)
        while len(left):
            best = pair.argmin(axis=1)
            rank = pair[np.arange(len(left)), best]
            done = rank == self.none
            if done.any():
                ended = ids[done]
                used = (ended >= 0).sum(axis=1)
                for i, n, row in zip(left[done].tolist(), used.tolist(), ended):
                    out[i] = row[:n].tobytes()
                left, ids, pair, best, rank = (x[~done] for x in (left, ids, pair, best, rank))
            rows = np.arange(len(left))
            ids[rows, best] = rank
            # close the gap behind the joined pair
            behind = columns > best[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            pair[:, :-1] = np.where(behind[:, 1:], pair[:, 1:], pair[:, :-1])
            pair[:, -1] = self.none
            ids[:, -1] = -1
            follow = ids[rows, best + 1]
            pair[rows, best] = np.where(follow >= 0, self.pair_ranks(rank, follow), self.none)
            lead = rows[best > 0]
            at = best[lead] - 1
            pair[lead, at] = self.pair_ranks(ids[lead, at], rank[lead])

    def long(self, piece: bytes) -> list[int]:
        """The same by a linked list and a heap of pairs: n log n steps for n bytes."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is joined to another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != upto:
                continue  # one of the two parts has changed since
            end[i], end[middle] = upto, 0
            if upto < n:
                before[upto] = i
                if (r := ranks.get(piece[i : end[upto]])) is not None:
                    heapq.heappush(heap, (r, i, end[upto]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:upto])) is not None:
                heapq.heappush(heap, (r, p, upto))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


@functools.cache
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


class PieceCache(dict):
    """Ids of pieces as little-endian 32-bit integers; emptied when full, so bounded.

    ``merge`` gives the ids of pieces that are not here yet, all together.
    """

    def __init__(self, merge, limit: int = CACHE_PIECES):
        super().__init__()
        self.merge, self.limit = merge, limit

    def of(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            names = [pieces[i] for i in new]
            made = self.merge(names)
            for i, ids in zip(new, made):
                found[i] = ids
            if len(self) + len(new) > self.limit:
                self.clear()
            self.update((n, ids) for n, ids in zip(names, made) if len(n) <= 64)
        return found


def merged_pieces(path: str):
    merging = merger(path)
    return lambda names: merging.many([n.encode("utf-8", "surrogatepass") for n in names])


def in_groups(texts: list[str], chars: int = BATCH_CHARS):
    """Consecutive texts of about ``chars`` characters together; one longer text is alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def encode_texts(texts: list[str], cache: PieceCache, chars: int = BATCH_CHARS):
    """(ids, ends) of each text: its ids, and how many of them each piece ends at."""
    for group in in_groups(texts, chars):
        pieces = Pieces(group)
        chosen, kind = pieces.distinct()
        made = cache.of(pieces.strings(chosen))
        sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
        flat = np.frombuffer(b"".join(made), "<u4")
        counts = sizes[kind]
        ends = np.cumsum(counts)
        place = (np.cumsum(sizes) - sizes)[kind] - (ends - counts)
        ids = flat[np.repeat(place, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.append(0, ends)
        for a, b in zip(pieces.bounds.tolist(), pieces.bounds[1:].tolist()):
            first, last = int(ends[a]), int(ends[b])
            yield ids[first:last], (ends[a + 1 : b + 1] - first).astype("<u4")


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., ids, ends): ids of the whole text and ends of its pieces, both binary.

    Both hold little-endian unsigned 32-bit integers. A null text counts as empty and has no
    ids; repeated rows and null ids stay as they are; an empty table gives no rows.
    """

    refuse_names(keep, "ids", "ends")
    text = free_name("__text__", *keep)

    def run(batches):
        cache = PieceCache(merged_pieces(path))
        for batch in text_slices(batches, text):
            table = pa.Table.from_batches([batch])
            texts = table[text].to_pylist()
            encoded = list(encode_texts(texts, cache))
            columns = {c: table[c] for c in keep}
            columns["ids"] = pa.array([i.tobytes() for i, _ in encoded], pa.binary())
            columns["ends"] = pa.array([e.tobytes() for _, e in encoded], pa.binary())
            yield from pa.table(columns).to_batches()

    rows = docs.select(*keep, whole_text(text_col).alias(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, ids binary, ends binary")


def decode_ids(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode_piece(ids: np.ndarray, ends: np.ndarray, piece: int, tokens: list[bytes]) -> bytes:
    """Bytes of one piece, by the ends kept with the ids."""
    first = int(ends[piece - 1]) if piece else 0
    return decode_ids(ids[first : int(ends[piece])], tokens)


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., decoded): the bytes that the ids stand for; no ids give no bytes."""

    def values(ids):
        return {"decoded": pa.array([decode_ids(x, token_bytes(path)) for x in ids], pa.binary())}

    return _per_row(encoded, keep, values, "decoded binary")


def digests(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, ids_sha256, decoded_sha256) of encoded rows and what they decode to."""

    def values(ids):
        tokens = token_bytes(path)
        names = [",".join(map(str, x.tolist())).encode() for x in ids]
        return {
            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in names], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(decode_ids(x, tokens)).hexdigest() for x in ids], pa.string()),
        }

    return _per_row(encoded, keep, values, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _per_row(encoded: DataFrame, keep: tuple[str, ...], values, kinds: str) -> DataFrame:
    def run(batches):
        for batch in text_slices(batches, "ids"):
            table = pa.Table.from_batches([batch])
            ids = [np.frombuffer(x or b"", "<u4") for x in table["ids"].to_pylist()]
            yield from pa.table({c: table[c] for c in keep} | values(ids)).to_batches()

    rows = encoded.select(*keep, "ids")
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("ids").schema]
    return rows.mapInArrow(run, ", ".join([*own, kinds]))
