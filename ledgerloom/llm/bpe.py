"""Op 10: exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is cut at special tokens and by the vocabulary's pattern. In each piece an automaton over all tokens
reports, at every position, the tokens that end there, longest first. The encoding of a prefix ends with
the one token that is compatible with the last token of the prefix before it; that token is stored, and
following the tokens back from the end gives the ids. Two tokens are compatible if byte-pair merging of
their bytes gives just these two again, which is tested by undoing their merges, latest first, and looking
for an earlier merge across the border. Pieces and pairs already seen are kept in tables of bounded size.

Defined cases: a null text is encoded as an empty one (no ids, empty decoded text); repeated rows are
encoded alike; an empty table gives no rows; a long text is read piece by piece; extra columns, of any name, pass
through, but that those named as OUTPUT are replaced.
"""

from __future__ import annotations

import functools
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import blocks, shielded, table

#: Pieces (and token pairs) that each worker remembers at most, and the longest piece of them: so the tables' bytes are bounded too.
REMEMBERED, LONGEST = 200_000, 64
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that the byte-level pre-tokenizer cuts texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OUTPUT = [T.StructField("__bpe_ids", T.BinaryType()), T.StructField("__bpe_decoded", T.StringType())]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _printable() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(spare)
        spare += b not in own
    return out


class Pieces(dict):
    """Piece to its ids, packed; an unseen piece is encoded and kept as long as there is room."""

    def __init__(self, codec: "Codec"):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.codec.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        chars = _printable()
        byte_of = {c: b for b, c in enumerate(chars)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {i: t.encode() if t in special else bytes(byte_of[c] for c in t) for t, i in [*model["vocab"].items(), *special.items()]}
        self.tokens = [as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)]
        self.special = special
        self.border = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair to (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token to (rank, left, right)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), (rank, whole))
            self.parts.setdefault(whole, (rank, left, right))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            raw = bytes(byte_of[c] for c in token)
            if len(raw) == 1 or i in self.parts:
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.findall = regex.compile(PATTERN).findall
        self.unusual = re.compile("[^\\x00-\u052f\u2010-\u2027\u3040-\u9fcc\uac00-\ud7a3]").search
        self.pieces = Pieces(self)
        sizes = np.array([len(t) for t in self.tokens])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two tokens before both are whole."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self._undone(left, right)
        return known

    def _undone(self, left: int, right: int) -> bool:
        # Going back in time, the border lies between ever smaller tokens. A merge of these is taken if it comes before
        # the merge that ends their time: the left one's, or the right one's, of which an equal rank goes leftmost first.
        until, of_right = len(self.merge) + 1, False
        while True:
            crossing = self.merge.get((left, right))
            if crossing and (crossing[0] < until or crossing[0] == until and of_right):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                until, left, of_right = a[0], a[2], False
            else:
                until, right, of_right = b[0], b[1], True

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[tuple[int, int]] = [(-1, 0)] * (len(piece) + 1)  # token that ends each prefix, and its length
        fixed, compatible = -1, self.compatible
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if end == fixed:
                continue
            start = end + 1 - size
            if not start or (last[start][1] and compatible(last[start][0], token)):
                last[end + 1] = (token, size)
                fixed = end
        ids, at = [], len(piece)
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def split(self, text: str) -> list[str]:
        """The pieces. Where Unicode versions may differ on what is a letter, the vocabulary's library cuts."""
        if self.unusual(text) is None:
            return self.findall(text)
        return [text[a:b] for _, (a, b) in _cutter().pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, out = self.pieces.__getitem__, []
        for k, part in enumerate(self.border.split(text) if self.border else [text]):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else b"".join(map(get, self.split(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        sizes = self.sizes[ids]
        total = np.cumsum(sizes)
        if not len(ids):
            return ""
        at = np.repeat(self.starts[ids] - total + sizes, sizes) + np.arange(total[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(1)
def _cutter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(path: str, names: list[str]):
    def coded(batches):
        own = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in blocks(batch, "text"):
                ids = [own.encode(t or "") for t in part.column(at).to_pylist()]
                back = [own.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.string())], names + [f.name for f in OUTPUT])
        # A worker goes on to other tasks: it must not hold this one's tables meanwhile.
        own.pieces.clear()
        own.pairs.clear()

    return coded


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of docs, the ids of text (packed as in Codec.encode) and the text decoded from them."""
    added = [f.name for f in OUTPUT]
    docs = docs.drop(*added)
    safe, names = shielded(docs, "text")
    return safe.mapInArrow(_coded(path or vocabulary_path(), names), T.StructType(safe.schema.fields + OUTPUT)).toDF(*docs.columns, *added)


def digests(coded: DataFrame) -> list:
    return [
        (F.octet_length("__bpe_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__bpe_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("__bpe_decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]


def op10_bpe_prefix_dp(spark, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", *digests(coded))
