"""Byte-pair encoding and decoding with a pair occurrence index.

A batch's distinct words are laid out in one symbol array linked by ``next``/``previous`` positions.  An
index maps each adjacent pair that has a merge rank to all its positions.  The active ranks are applied in
ascending order, each to all its positions at once; the neighbours that a merge changes enter the lists of
their new pairs.  Words and space-separated chunks are interned per Arrow batch (and in a bounded cache per
Python worker), so that each distinct word is merged once and texts become gathers of id runs.

Results do not depend on batches, partitions or the cache; a lost executor only repeats its own partitions.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import column_of, id_text, slices, vocab_path

GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Every character that some regex engine counts as white space; a piece that ends with one is cut with care.
SPACES = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))
NO_RANK = 0xFFFF


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairIndexBPE:
    """Merges batches of words with a pair occurrence index.  ``suffix`` marks a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        chars = byte_chars()
        self.base = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left.tolist(), right.tolist()
        self.made = [vocab[a + b] for a, b in merges]
        keys = left << 17 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], 1 << 62), np.append(order, NO_RANK)
        # Ranks of all pairs of single-byte symbols, in the middle of a word and at its end.
        self.first = self.rank((self.base[:, None] << 17 | self.base[None, :]).ravel()).astype(np.uint16)
        self.final = self.rank((self.base[:, None] << 17 | self.last[None, :]).ravel()).astype(np.uint16)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in one array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), sizes
        ends = np.cumsum(sizes)[sizes > 0] - 1
        sym = self.base[raw]
        sym[ends] = self.last[raw[ends]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts = np.append(0, ends[:-1] + 1)
        nxt[ends], prv[starts] = -1, -1
        ranks = np.full(n, NO_RANK, dtype=np.uint16)
        if n > 1:
            pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
            ranks[:-1] = self.first[pair]
            before = ends[prv[ends] >= 0] - 1
            ranks[before] = self.final[pair[before]]
            ranks[ends] = NO_RANK
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        order, ranks = order[: (stop := int(np.searchsorted(ranks, NO_RANK)))], ranks[:stop].astype(np.int64)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        self._enter(index, heap, ranks, order)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            nx = nxt[at]
            ok = (sym[at] == a) & (nx >= 0) & (sym[nx] == b)
            at = at[ok]
            if not len(at):
                continue
            if a == b:  # overlapping runs: leftmost first
                at = np.sort(at)
                keep, taken = [], -1
                for p, q in zip(at.tolist(), nxt[at].tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, dtype=np.int64)
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone], nxt[at] = self.made[r], -2, after
            inner = after >= 0
            prv[after[inner]] = at[inner]
            outer = prv[at] >= 0
            new = np.concatenate([at[inner], prv[at[outer]]])
            if len(new):
                got = self.rank(sym[new] << 17 | sym[nxt[new]])
                ok = got != NO_RANK
                got, new = got[ok], new[ok]
                if len(got) > 1:
                    order = np.argsort(got, kind="stable")
                    got, new = got[order], new[order]
                self._enter(index, heap, got, new)
        alive = sym >= 0
        counts = np.zeros(len(words), dtype=np.int64)
        counts[sizes > 0] = np.add.reduceat(alive.astype(np.int64), starts)
        return sym[alive].astype(np.uint32), counts

    @staticmethod
    def _enter(index: dict[int, list[np.ndarray]], heap: list[int], ranks: np.ndarray, at: np.ndarray) -> None:
        """Add positions, sorted by rank, to the lists of their ranks."""
        if not len(ranks):
            return
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for r, i, j in zip(ranks[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            lists = index.get(r)
            if lists is None:
                index[r] = [at[i:j]]
                heapq.heappush(heap, r)
            else:
                lists.append(at[i:j])


class Codec:
    """A vocabulary file with its splitting rules, and a bounded cache from words to ids.

    ``kind`` is "byte" (byte-level pieces, spaces kept) or "word" (lower case, word ends, spaces dropped).
    """

    #: Chunks that a Python worker keeps; further ones are encoded again in each batch.
    CACHE = 150_000
    SIGNS = frozenset(".,;:!?")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.kind = "word" if suffix else "byte"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bpe = PairIndexBPE(model["vocab"], [tuple(m) for m in model["merges"]], suffix)
        pattern = GPT_PATTERN if self.kind == "byte" else next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        back = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in model["vocab"].items():
            word_end = suffix and token.endswith(suffix)
            self.bytes_of[i] = bytes(back[c] for c in (token[: -len(suffix)] if word_end else token)) + (b" " if word_end else b"")
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cache: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def split(self, text: str) -> list[str]:
        """The words of a text that holds no special token, in order."""
        if self.kind == "word":
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                # one character at a time: no final-sigma rule
                return self.words("".join(map(str.lower, text)) if "Σ" in text else text.lower())
            text = text.lower()
        return self.words(text)

    def parts(self, text: str) -> list:
        """Words of any text, in order; special tokens come as 1-tuples."""
        body = text[:-1] if text[-1:] in self.SIGNS else text
        if body.isalpha():  # one plain word, perhaps with a sign at its end
            if self.kind == "word":
                body = body.lower() if body.isascii() else unicodedata.normalize("NFC", body).lower()
            if self.kind == "byte" or (body.isalpha() and "ς" not in body and "σ" not in body):
                return [body, text[-1]] if text[-1] in self.SIGNS else [body]
        if "<|" not in text or not any(s in text for s in self.special):
            return self.split(text)
        out: list = []
        for piece in self.cut(text):
            out += [(piece,)] if piece in self.special else self.split(piece)
        return out

    def runs(self, chunks: list[str], lead: str = "") -> list[bytes]:
        """The ids of each chunk, after ``lead``, as little-endian 32-bit bytes."""
        cache = self.cache[lead]
        out = list(map(cache.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        parts = [self.led(chunks[i]) if lead else self.parts(chunks[i]) for i in missing]
        words = list({w for p in parts for w in p if type(w) is str})
        ids, counts = self.bpe.encode([w.encode("utf-8", "replace") for w in words])
        flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        of: dict = dict(zip(words, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        of |= {(s,): i.to_bytes(4, "little") for s, i in self.special.items()}
        for i, p in zip(missing, parts, strict=True):
            out[i] = of[p[0]] if len(p) == 1 else b"".join([of[w] for w in p])
        room = self.CACHE - len(cache)
        if room > 0:
            cache.update((chunks[i], out[i]) for i in missing[:room])
        return out

    def led(self, text: str) -> list:
        """Words of a chunk that a space precedes."""
        if text.isalpha():
            return [" " + text]
        if text[-1:] in self.SIGNS and text[:-1].isalpha():
            return [" " + text[:-1], text[-1]]
        return self.parts(" " + text)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in one array (uint32), and the offset of each text in it."""
        column = pc.fill_null(column.cast(pa.string()), "")
        pieces = pc.split_pattern(column, " ")
        flat = pieces.flatten()
        lengths = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        firsts = ends - lengths
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = coded.dictionary.to_pylist()
        n = len(values)
        if self.kind == "word":
            first_values = []
            slow = np.zeros(len(column), dtype=bool)
        else:
            # A cut before a space is safe after a piece that ends with something else than white space.
            unsafe = np.fromiter((not v or v[-1] in SPACES for v in values), dtype=bool, count=n)[index]
            unsafe[ends - 1] = False
            slow = np.logical_or.reduceat(unsafe, firsts) if len(firsts) else np.zeros(0, bool)
            first_index = index[firsts]
            used, where = np.unique(first_index, return_inverse=True)
            first_values = [values[i] for i in used.tolist()]
            index[firsts] = n + where
        for s in self.special:  # may hold a space's neighbours: the whole text is cut at them
            if self.kind == "byte":
                slow |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        slow_rows = np.flatnonzero(slow)
        runs = self.runs(values, "" if self.kind == "word" else " ")
        runs += self.runs(first_values + [column[i].as_py() for i in slow_rows.tolist()]) if self.kind == "byte" else []
        if len(slow_rows):  # such a text's pieces give way to one run
            keep = np.repeat(~slow, lengths)
            keep[firsts[slow_rows]] = True
            index[firsts[slow_rows]] = n + len(first_values) + np.arange(len(slow_rows))
            lengths = np.where(slow, 1, lengths)
            index = index[keep]
            ends = np.cumsum(lengths)
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // 4
        table = np.frombuffer(b"".join(runs), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        stops = np.cumsum(each)
        total = int(stops[-1]) if len(stops) else 0
        gather = np.repeat(starts[index] - (stops - each), each) + np.arange(total)
        return table[gather], np.append(0, np.append(0, stops)[ends])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes the replacement character."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removesuffix(" ") if self.kind == "word" else text


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The codec of a vocabulary file, loaded once per Python worker."""
    if name not in _codecs:
        _codecs[name] = Codec(vocab_path(name))
    return _codecs[name]


def encode(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: ``doc_id, ids array<int>``; a null or empty text has no ids, a null id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in slices(batches, max_bytes=8 << 20):
            ids, offsets = c.encode_column(column_of(b, "_text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), lists], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: ``doc_id, text``; null ids give the empty text."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in batches:
            texts = [c.decode(np.asarray(x or [], dtype=np.int64)) for x in column_of(b, "_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(b, "_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, encoded and decoded in one pass.

    Only digests are kept, so that no ids are shuffled or stored.  A null or empty text has no tokens; texts of any
    length are encoded whole; repeated rows give a row each; a null id stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab)
        for b in slices(batches, max_bytes=8 << 20):
            ids, offsets = c.encode_column(column_of(b, "_text"))
            edges = offsets.tolist()
            docs_ids = [ids[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(b, "_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in docs_ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in docs_ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
