"""SentencePiece encoding by a unigram Viterbi search over a double-array trie, and decoding."""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrack.llm.common import map_texts

SPACE = "▁"
#: What an unknown character costs below the least score of all pieces.
UNKNOWN_PENALTY = 10.0
#: Parts of texts whose ids a worker remembers at most.
MEMORY = 400_000


@dataclass
class Vocabulary:
    """``base``, ``check``, ``value``: the double array over UTF-8 bytes; value is a piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    raw: list[bytes]  # what each id decodes to
    bytes_at: list[int]  # the id of each byte
    unknown: float


def double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: the child of node n by byte b is t = base[n] + b where check[t] is n."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for word, number in words:
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                values.append(-1)
            node = children[node][b]
        values[node] = number
    size = 2 * len(children) + 512
    base, check, value, used = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
    used[0] = True
    value[0], place, first = values[0], {0: 0}, 1
    queue = [0]
    for node in queue:
        if not children[node]:
            continue
        labels = np.array(sorted(children[node]))
        at = max(first - int(labels[0]), 1)
        while True:
            if at + 2048 > len(used) - 256:
                grow = len(used)
                base, check, value, used = np.pad(base, (0, grow)), np.pad(check, (0, grow), constant_values=-1), np.pad(value, (0, grow), constant_values=-1), np.pad(used, (0, grow))
            open_at = np.flatnonzero(~used[np.arange(at, at + 1024)[:, None] + labels].any(axis=1))
            if len(open_at):
                at += int(open_at[0])
                break
            at += 1024
        if at + int(labels[0]) - first > 4096:  # leave a nearly full stretch behind
            first = at + int(labels[0]) - 2048
        base[place[node]] = at
        for b in labels.tolist():
            child = children[node][b]
            used[at + b], check[at + b], value[at + b] = True, place[node], values[child]
            place[child] = at + b
            queue.append(child)
        while used[first]:
            first += 1
    return base, check, value


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, its scores taken as the pieces' log scores.

    Raises ValueError where a piece has a space marker behind another character.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in ids]
    if any(SPACE in names[i].lstrip(SPACE) for i in plain):
        raise ValueError("a piece has a space marker behind another character: texts of this vocabulary cannot be cut at spaces")
    scores = np.array([model.get_score(i) for i in ids])
    bytes_at, raw = [-1] * 256, [n.replace(SPACE, " ").encode() for n in names]
    for i in ids:
        if model.is_byte(i):
            bytes_at[int(names[i][3:5], 16)] = i
            raw[i] = bytes([int(names[i][3:5], 16)])
        elif model.is_control(i) or model.is_unknown(i):
            raw[i] = b""
    return Vocabulary(*double_array([(names[i].encode(), i) for i in plain]), scores, raw, bytes_at, float(scores[plain].min()) - UNKNOWN_PENALTY)


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes.

    No piece has a space marker behind another character, so the best path of a text is
    made of the best paths of its parts, each a run of markers and what follows it; parts
    are remembered.
    """

    PART = re.compile(" +[^ ]*")

    def __init__(self, vocabulary: Vocabulary):
        self.base, self.check, self.value = (x.tolist() for x in (vocabulary.base, vocabulary.check, vocabulary.value))
        self.scores, self.vocabulary, self.known = vocabulary.scores.tolist(), vocabulary, {}
        self.table = np.array(vocabulary.raw, object)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        parts = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [p[1:] for p in self.PART.findall(" " + text)]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > MEMORY:  # the older half goes
                for part in list(islice(known, len(known) // 2)):
                    del known[part]
            for part in set(parts).difference(known):
                known[part] = array("I", self.best_path(SPACE + part.replace(" ", SPACE))).tobytes()
            return b"".join(map(known.__getitem__, parts))

    def best_path(self, part: str) -> list[int]:
        """Viterbi: of equal paths the one found first stays; unknown characters become byte pieces."""
        base, check, value, scores, size = self.base, self.check, self.value, self.scores, len(self.check)
        raw = part.encode("utf-8", "surrogatepass")
        n = len(raw)
        best, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = raw[at]
            end = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, node, k, whole = best[at], 0, at, False
            while k < n:
                t = base[node] + raw[k]
                if t >= size or check[t] != node:
                    break
                node, k = t, k + 1
                found = value[node]
                if found >= 0:
                    whole = whole or k == end
                    if here + scores[found] > best[k]:
                        best[k], start[k], piece[k] = here + scores[found], at, found
            if not whole and here + self.vocabulary.unknown > best[end]:
                best[end], start[end], piece[end] = here + self.vocabulary.unknown, at, -1
            at = end
        out, at = [], n
        while at:
            out.append([piece[at]] if piece[at] >= 0 else [self.vocabulary.bytes_at[b] for b in raw[start[at] : at]])
            at = start[at]
        return [i for ids in reversed(out) for i in ids]

    def decode(self, ids: bytes) -> str:
        """The text: bytes joined (broken ones replaced), markers as spaces, without the leading one."""
        text = b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_chars, decoded_crc32, round_trip), one row per document.

    ids_crc32 is over little-endian 32-bit ids. ``round_trip`` says that decoding the ids gave
    the text back, space markers in it read as spaces. Null texts count as empty (no pieces).
    Repeated rows come back as often as they come, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encode = Encoder(shared.value)
        byte_piece = np.zeros(len(shared.value.raw), bool)
        byte_piece[[i for i in shared.value.bytes_at if i >= 0]] = True

        def run(texts: list[str]) -> dict[str, pa.Array]:
            rows = []
            for text in texts:
                ids = encode(text)
                back = encode.decode(ids)
                rows.append((len(ids) // 4, int(byte_piece[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), len(back), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text.replace(SPACE, " ")))
            names = ("n_pieces", "n_byte_pieces", "ids_crc32", "decoded_chars", "decoded_crc32", "round_trip")
            return {name: pa.array([r[k] for r in rows], pa.bool_() if k == 5 else pa.int64()) for k, name in enumerate(names)}

        return run

    return map_texts(docs, make, "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean", text, (doc_id,))
