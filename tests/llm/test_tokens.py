"""BPE, pre-tokens and token files against the public libraries."""

import random
import zlib

import numpy as np
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from frostline.llm import bpe, token_files
from frostline.llm.pretokens import Pieces, piece_offsets
from frostline.llm.queries import vocabulary
from tests.llm.helpers import documents, empty, rows, sha

# Fixed value: the pattern that the scan stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")
JSON = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def samples():
    rng = random.Random(3)
    letters = "ab'srtvelmd  \n\t 12é!?.　\x85\x1c 北😀'\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [
        "", "'", " " * 700, "'ll" * 400, "a" * 3000, "x'", "\n",
    ]


def test_pieces_are_those_of_the_pattern():
    texts = samples()
    for text, cut in zip(texts, piece_offsets(texts)):
        assert [text[a:b] for a, b in zip(cut, cut[1:])] == regex.findall(PATTERN, text)


def test_distinct_pieces():
    pieces = Pieces(samples())
    chosen, kind = pieces.distinct()
    names = pieces.strings(chosen)
    every = pieces.strings(np.arange(len(pieces.starts)))
    assert len(set(names)) == len(names) and [names[k] for k in kind] == every


def test_ids_and_offsets(encoding):
    cache = bpe.PieceCache(bpe.merged_pieces(RANKS), limit=50)  # emptied many times
    texts, tokens = samples(), bpe.token_bytes(RANKS)
    for text, (ids, ends) in zip(texts, bpe.encode_texts(texts, cache)):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert bpe.decode_ids(ids, tokens) == text.encode()
        cut = piece_offsets([text])[0]
        for k in range(len(ends)):
            assert bpe.decode_piece(ids, ends, k, tokens) == text[cut[k] : cut[k + 1]].encode()


def test_merges_of_long_pieces(encoding):
    rng = random.Random(1)
    merging = bpe.merger(RANKS)
    for _ in range(300):
        piece = "".join(rng.choice("thenaio") for _ in range(rng.randint(1, 90)))
        assert merging.long(piece.encode()) == encoding.encode_ordinary(piece)


def test_bpe_query(spark, encoding):
    found = bpe.digests(bpe.encode(documents(spark), RANKS), RANKS).collect()
    wanted = []
    for doc_id, text, *_ in rows():
        ids = encoding.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert bpe.digests(bpe.encode(empty(spark), RANKS), RANKS).count() == 0
    decoded = bpe.decode(bpe.encode(documents(spark), RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for _, t, *_ in rows())


@pytest.mark.parametrize("top", [0, 7, 5000, 2**40])
@pytest.mark.parametrize("n", [0, 1, 700, 5000])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    coded = token_files.EliasFano.of(values)
    data = coded.to_bytes()
    read, end = token_files.EliasFano.from_bytes(b"__" + data, 2)
    assert end == len(data) + 2 and (read.block(0, n) == values).all()
    assert all(read.select(i) == values[i] for i in range(n))
    for first, count in ((0, 1), (1, 7), (511, 3), (513, 4096), (n - 1, 5), (n, 5)):
        assert read.block(max(first, 0), count).tolist() == values[max(first, 0) : max(first, 0) + count].tolist()
    if n > 1000:
        assert 8 * len(data) < n * (3 + max(0, np.log2(max(1, top / n)))) + 3000


def _by_library():
    tokenizer = Tokenizer.from_file(JSON)
    out, start = [], 0
    for doc_id, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    out = f"file://{tmp_path}/tokens"
    found = token_files.documents_from_files(spark, documents(spark), JSON, out).orderBy("start").collect()
    wanted = _by_library()
    # rows of one id may stand in any order among themselves
    assert [r.doc_id for r in found] == [w[0] for w in wanted]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(w[0]), w[2], w[3]) for w in wanted)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()


def _bounds(parts):
    return [(a, b) for _, starts, ends, _ in parts for a, b in zip(starts.tolist(), ends.tolist())]


def test_library_pieces():
    tokenizer = Tokenizer.from_file(JSON)
    names = [" the", "the", " Über", "  ", " x1", " 12", "'s", " antidis", " a", "!?", "\n", " zzqxv", " ", "北京"] * 3
    names += [f" {chr(97 + i % 26)}{'qwx'[i % 3]}{chr(97 + i // 26 % 26)}" for i in range(2000)]
    cache = token_files.LibraryPieces(tokenizer)
    cache.limit = 300  # generations change many times
    for at in range(0, len(names), 100):
        part = list(dict.fromkeys(names[at : at + 100]))
        for name, ids in zip(part, cache.of(part)):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(name, add_special_tokens=False).ids, name


def test_token_files_by_select(spark, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_files.write_token_files(documents(spark), JSON, out, shards=1)
    shard, tokenizer = token_files.Shard(out, 0), Tokenizer.from_file(JSON)
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    read = [list(shard.blocks(n)) for n in (1, 3, token_files.BLOCK)]
    for parts in read:  # the same documents, however many are read at a time
        assert [x for ids, *_ in parts for x in ids.to_pylist()] == [x for ids, *_ in read[0] for x in ids.to_pylist()]
        assert [x for *_, crcs in parts for x in crcs.tolist()] == [x for *_, crcs in read[0] for x in crcs.tolist()]
    for i, doc_id in enumerate(x for ids, *_ in read[-1] for x in ids.to_pylist()):
        assert [starts_ends[k] for starts_ends in _bounds(read[0]) for k in (0, 1)][2 * i : 2 * i + 2] == list(shard.span(i))
        if doc_id is not None:
            assert shard.document(i).tolist() == [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2]
    assert token_files.documents_from_files(spark, empty(spark), JSON, f"file://{tmp_path}/none").count() == 0
