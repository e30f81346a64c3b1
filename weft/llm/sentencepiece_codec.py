"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, by an own agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

SPACE = "▁"
#: Segments that a worker remembers within a task in each of two generations (when the younger is full it becomes the
#: older, which is forgotten), the longest that it remembers, and the longest that it merges among others.
CACHE, KEPT_CHARS, CACHED_CHARS = 150_000, 200, 48


class Codec:
    """Encodes as the library does, for identity-normalised BPE vocabularies with byte fallback.

    The text gets a leading space and spaces become U+2581. Symbols start as characters; the agenda holds every
    adjacent pair whose concatenation is a piece, the highest score first and of equal ones the leftmost. The top pair
    merges, its neighbours enter, entries that a merge has outdated are skipped. Symbols left outside the vocabulary
    become one byte piece for each byte of UTF-8.

    No merge can cross a place where no piece spans both sides, so the text is cut there first and each segment is
    merged by itself: before a space run (if no piece has a space after another character), and around characters
    that only occur in pieces of length one. Both facts are read from the vocabulary, not assumed.
    """

    def __init__(self, model: str, hold: bool = True):
        import sentencepiece

        #: Whether each segment is held against the library when it is met; needless if every text is, as a whole.
        self.hold = hold
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.vocab_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        usable = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte fallback")
        probe = "  ﬁ a\t b　é  "
        if lib.decode(lib.encode(probe)) != probe:
            raise ValueError("the vocabulary normalises text; only identity normalisation is supported")
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        inner = "".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))
        runs_lead = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        word = f"[{re.escape(inner)}]+"
        self.cutter = re.compile(f"{SPACE}*{word}|{SPACE}+|[^{re.escape(inner)}{SPACE}]") if runs_lead else re.compile(r"(?s).+")
        self.fast = runs_lead and "\n" not in inner
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._pairs(inner)

    def _pairs(self, inner: str) -> None:
        """Tables for merging many segments at once: symbols by number, and every pair that makes a piece."""
        symbols = {**self.ids}
        for c in inner + SPACE:
            symbols.setdefault(c, len(self.text_of) + 1_000_000 + ord(c))
        self.symbol_of = np.full(0x110000, -2, np.int32)
        for c in (c for c in symbols if len(c) == 1):
            self.symbol_of[ord(c)] = symbols[c]
        for b in range(128):  # ASCII outside the vocabulary is its byte piece from the start: no pair has it
            if chr(b) not in symbols:
                self.symbol_of[b] = self.bytes[b]
        #: What each id adds to a decoded text, in UTF-8; byte pieces one byte, control pieces nothing.
        self.raw_of = [b""] * self.library.vocab_size()
        for i, x in self.text_of.items():
            self.raw_of[i] = x.encode("utf-8", "surrogatepass")
        for b, i in enumerate(self.bytes):
            self.raw_of[i] = bytes([b])
        if self.unk >= 0:
            self.raw_of[self.unk] = " ⁇ ".encode()
        # The same end to end, with the size and place of each.
        self.raw, self.raw_size = np.frombuffer(b"".join(self.raw_of), np.uint8), np.array(list(map(len, self.raw_of)), np.int64)
        self.raw_at = self.raw_size.cumsum() - self.raw_size
        #: For each closing mark, the characters that stand before it in some piece.
        self.joined = {m: {p[k - 1] for p in self.ids for k in range(1, len(p)) if p[k] == m} for m in ".,;:!?"}
        known = [(symbols[p[:k]] << 32 | symbols[p[k:]], -self.scores[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, cost, made = zip(*sorted(known), strict=True)
        keys, self.pair_cost, self.pair_made = np.array(keys, np.int64), np.array([*cost, np.inf], np.float32), np.array([*made, -1], np.int32)
        # Open addressing: the place of a pair's key among four times as many slots or more, the next free one if taken.
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())
        self.slots = np.full((1 << (64 - int(self.shift))) + len(keys), -1, np.int64)
        self.slot_pair = np.full(len(self.slots), len(keys), np.int32)
        rest, at = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.slots[at] == -1
            first = np.zeros(len(rest), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.slot_pair[at[put]] = keys[rest[put]], rest[put]
            rest, at = rest[~put], at[~put] + (~free)[~put]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (infinite if they make no piece) and product of symbol pairs; negative symbols make none."""
        q = ((left.astype(np.int64) << 32) | np.maximum(right, 0)).ravel()
        q[((left < 0) | (right < 0)).ravel()] = -2
        at = self._slot(q)
        held = self.slots[at]
        pair = np.where(held == q, self.slot_pair[at], len(self.pair_cost) - 1)
        rest = np.nonzero((held != q) & (held != -1) & (q >= 0))[0]
        while len(rest):
            at[rest] += 1
            held = self.slots[at[rest]]
            hit = held == q[rest]
            pair[rest[hit]] = self.slot_pair[at[rest[hit]]]
            rest = rest[~hit & (held != -1)]
        return self.pair_cost[pair].reshape(left.shape), self.pair_made[pair].reshape(left.shape)

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment: the agenda of merge() for all of them in step, one merge of each at a time.

        Row k of `cost` is segment k's agenda, one place for each symbol and its right neighbour; the lowest cost is
        the highest score, and argmin takes the leftmost of equal ones.
        """
        out: list[bytes] = [b""] * len(segments)
        highs = (4, 6, 8, 10, 12, 14, 16, 20, 26, 34, CACHED_CHARS)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        group = np.searchsorted(highs, sizes)
        for number, high in enumerate(highs):
            alike = np.nonzero(group == number)[0].tolist()
            for start in range(0, len(alike), 4096):  # so many that their arrays stay in a processor's cache
                own = alike[start : start + 4096]
                for k, ids in zip(own, self._merge_rows([segments[k] for k in own], high), strict=True):
                    out[k] = ids
        for k in np.nonzero(group == len(highs))[0].tolist():
            out[k] = self.segment(segments[k])
        return out

    def _merge_rows(self, segments: list[str], high: int) -> list[bytes]:
        n = len(segments)
        chars = "".join([x.ljust(high) for x in segments]).encode("utf-32-le", "surrogatepass")
        sym = np.full((n, high + 1), -1, np.int32)  # place `high`: nothing
        sym[:, :high] = self.symbol_of[np.frombuffer(chars, np.uint32).reshape(n, high)]
        sym[:, :high][np.arange(high)[None, :] >= np.array([len(x) for x in segments])[:, None]] = -1  # behind its end
        after, before = np.tile(np.arange(1, high + 1, dtype=np.int16), (n, 1)), np.tile(np.arange(-1, high - 1, dtype=np.int16), (n, 1))
        cost, made = np.full((n, high + 1), np.inf, np.float32), np.zeros((n, high + 1), np.int32)
        cost[:, : high - 1], made[:, : high - 1] = self._look(sym[:, : high - 1], sym[:, 1:high])
        rows = np.arange(n)
        while len(rows):
            k = cost[rows].argmin(1)
            on = cost[rows, k] < np.inf
            rows, k = rows[on], k[on]
            right = after[rows, k]
            sym[rows, k] = made[rows, k]
            sym[rows, right] = -1
            cost[rows, right] = np.inf
            beyond, left = after[rows, right], before[rows, k]
            after[rows, k] = beyond
            inside = beyond < high
            before[rows[inside], beyond[inside]] = k[inside]
            inside = left >= 0
            r, x, y = rows[inside], left[inside], k[inside]
            new_cost, new_made = self._look(np.concatenate([sym[rows, k], sym[r, x]]), np.concatenate([sym[rows, beyond], sym[r, y]]))
            cost[rows, k], made[rows, k] = new_cost[: len(rows)], new_made[: len(rows)]
            cost[r, x], made[r, x] = new_cost[len(rows) :], new_made[len(rows) :]
        plain = (sym > -2).all(1) & (sym < 1_000_000).all(1)
        sizes = (sym >= 0).sum(1) * 4
        flat, ends = sym[sym >= 0].astype("<u4").tobytes(), np.cumsum(sizes).tolist()
        return [flat[end - size : end] if ok else self.segment(x) for x, ok, end, size in zip(segments, plain.tolist(), ends, sizes.tolist(), strict=True)]

    def merge(self, text: str) -> list[str]:
        """The symbols that the agenda leaves of one segment."""
        sym = list(text)
        n = len(sym)
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(both := sym[a] + sym[b])) is not None:
                heapq.heappush(agenda, (-score, a, b, both))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or after[a] != b or len(sym[a]) + len(sym[b]) != len(both):
                continue
            sym[a], sym[b] = both, ""
            after[a] = c = after[b]
            if c >= 0:
                prev[c] = a
            offer(prev[a], a)
            offer(a, c)
        return [s for s in sym if s]

    def segment(self, text: str) -> bytes:
        """The segment's ids as little-endian 32-bit integers."""
        ids: list[int] = []
        for s in self.merge(text):
            i = self.ids.get(s)
            ids += [i] if i is not None else [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def pieces_text(self, ids: list[int]) -> str:
        """Pieces joined, byte runs decoded as UTF-8; what is not UTF-8 becomes U+FFFD for each byte."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            while raw:
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out += [raw[: e.start].decode(), "�"]
                    del raw[: e.start + 1]
            if i is not None:
                out.append(self.text_of.get(i, " ⁇ " if i == self.unk else ""))
        return "".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text (little-endian 32-bit, without begin and end).

        Segments are known by what stands between spaces; one without a space before it begins with a line feed.
        Texts with runs of spaces, with spaces at an end or with U+2581 are cut by the vocabulary's own rule instead.
        """
        cut: list[list[str] | None] = []
        for text in texts:
            t = text.replace("\n", " \n")
            slow = not self.fast or not t or t[0] == " " or t[-1] == " " or "  " in t or SPACE in t
            cut.append(None if slow else t.split(" "))
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        held = [[*map(self.cache.get, words)] if words else [] for words in cut]
        new = set(itertools.chain.from_iterable(itertools.compress(words or (), map(operator.not_, ids)) for words, ids in zip(cut, held, strict=True)))
        again = [x for x in new if x in self.older]
        self.cache.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new.difference_update(again)
        self._learn(new)
        ids_of = self.cache.__getitem__
        out = [b"".join([y or ids_of(x) for x, y in zip(words, ids, strict=True)]) if words else self.encode(text) for words, ids, text in zip(cut, held, texts, strict=True)]
        for x in [x for x in new if len(x) > KEPT_CHARS]:
            del self.cache[x]
        return out

    def _learn(self, new: set[str]) -> None:
        """Remembers the ids of segments, after holding them against the library's if the texts are not held.

        A closing mark that no piece joins to the character before it is a segment of its own.
        """
        marked = {x: x[:-1] for x in new if x[-1] in self.joined and len(x) > 1 and x[-2] not in self.joined[x[-1]]}
        stems = list(new.difference(marked) | set(marked.values()).difference(self.cache))
        self.cache.update(zip(stems, self.merge_many([x if x[0] == "\n" else SPACE + x for x in stems]), strict=True))
        marks = {m: self.segment(m) for m in self.joined}
        for x, stem in marked.items():
            self.cache[x] = self.cache[stem] + marks[x[-1]]
        for lead in (0, 1) if self.hold else ():  # before a line feed the library puts a space, which is a piece of its own
            some = [x for x in new if (x[0] == "\n") == lead]
            theirs = self.library.encode(some)
            theirs = [ids[1:] for ids in theirs] if lead else theirs
            own = list(map(self.cache.__getitem__, some))
            sizes, flat = list(map(len, theirs)), list(itertools.chain.from_iterable(theirs))
            if np.array(flat, "<u4").tobytes() != b"".join(own) or 4 * np.array(sizes) @ np.arange(len(sizes)) != np.array(list(map(len, own))) @ np.arange(len(sizes)):
                raise AssertionError("segments differ from the sentencepiece library")

    def encode(self, text: str) -> bytes:
        """As encode_batch for one text, cut by the vocabulary's rule."""
        if not text:
            return b""
        return b"".join(self.merge_many(self.cutter.findall(SPACE + text.replace(" ", SPACE))))

    def _raw_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.raw_size[ids]
        ends = sizes.cumsum()
        return self.raw[np.repeat(self.raw_at[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode_raw(self, ids: list[int] | np.ndarray) -> bytes:
        """The text of any ids in UTF-8; begin and end ids give nothing, and the leading space that encoding adds goes.

        The bytes of all ids are joined; if they are not UTF-8, or if ids stand among them that give nothing, each run
        of byte pieces is decoded by itself.
        """
        ids = np.asarray(ids, np.int64)
        sizes = self.raw_size[ids]
        raw, apart = b"".join([self._raw_bytes(ids[k : k + 50_000]) for k in range(0, len(ids), 50_000)]), not sizes.all()
        try:
            raw.decode()
        except UnicodeDecodeError:
            apart = True
        if apart:
            raw = self.pieces_text(ids.tolist()).encode("utf-8", "surrogatepass")
        first = ids[sizes > 0][:1].tolist()
        return raw[1:] if first and first[0] in self.text_of and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_raw(ids).decode("utf-8", "surrogatepass")

    def check(self, text: str, ids: bytes, decoded: bytes) -> None:
        """Raises unless the library gives the same ids, with begin and end ids, and the same text for them."""
        theirs = self.library.encode_as_numpy(text, add_bos=True, add_eos=True)
        if theirs.astype("<u4", copy=False).tobytes() != ids or self.library.decode(theirs, return_type=bytes) != decoded:
            raise AssertionError(f"differs from the sentencepiece library on a text of {len(text)} characters: {text[:80]!r}")


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check_one_in: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every row's whole text, with begin and end ids.

    One pass in Arrow batches, no shuffle. Every text's ids and their decoding are held against the library's, whole; a
    difference fails the job. With check_one_in above 1 only one text in so many is (by crc32 of the text, so reruns
    agree; 0: none), and segments when a task meets them in a text without runs of spaces. Null and empty texts have
    the begin and end ids only and decode to an empty text. Texts that are not Unicode (lone surrogates) do not occur
    in Spark strings. Repeated rows and null ids each give their row; other columns of docs are ignored. model is a
    path that executors can read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(model, hold=check_one_in != 1)  # belongs to the task, so the worker keeps nothing of it
        bos, eos = c.bos.to_bytes(4, "little"), c.eos.to_bytes(4, "little")
        for batch in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for start in range(0, batch.num_rows, 1000):
                some = [x or "" for x in batch.column(1).slice(start, 1000).to_pylist()]
                found = dict.fromkeys(some)  # equal texts are encoded once
                for text, packed in zip(found, c.encode_batch(list(found)), strict=True):
                    ids, whole = np.frombuffer(packed, "<u4"), bos + packed + eos
                    decoded = c.decode_raw(ids)
                    if check_one_in == 1 or check_one_in and zlib.crc32(text.encode("utf-8", "surrogatepass")) % check_one_in == 0:
                        c.check(text, whole, decoded)
                    found[text] = len(ids) + 2, hashlib.sha256(whole).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids, decoded) if with_ids else ())
                for size, one, other, *rest in map(found.__getitem__, some):
                    n.append(size)
                    ids_sha.append(one)
                    text_sha.append(other)
                    if with_ids:
                        all_ids.append([c.bos, *rest[0].tolist(), c.eos])
                        texts.append(rest[1].decode("utf-8", "surrogatepass"))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
