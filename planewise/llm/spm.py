"""SentencePiece encoding and decoding by a max-plus scan.

The vocabularies here are merge-ranked: a text's encoding is what its library gets by merging, time and
again, the two neighbours whose joint piece ranks best (the leftmost of equals).  That is also a path
problem.  Two pieces may follow each other if merging their joint text gives just these two, and a path
of pieces is the encoding exactly if every piece may follow the one before: merges inside a stretch
happen in the same order whatever stands beside it, as long as none crosses its ends.  So an arc weighs
the ids it spells, a pair that may not be is minus infinity, and any path that is left from one
piece to another is the only one.  Characters in no piece are spelt in byte pieces.

Where no piece can cross a place (before a space sign that follows another character, beside a line feed)
any pair may follow, so words are solved one by one and common ones once per worker.

Giant documents are cut into chunks of ``chunk`` characters that different tasks solve:

* The state at a cut is the piece over the character before it.  Each chunk yields the max-plus matrix from entry
  states to exit states; its entries count the ids between them.
* The matrices of a document are combined associatively in a tree of ``FAN`` children a node, one Spark stage a level.
  Then the states go down the tree again: a node's entry and exit state give those of its children.
* Each chunk is traced back for itself between its two states.

The ids are those of the library for any ``chunk``.

Contract: decoding an encoding gives the text exactly, also with literal U+2581 (spelt in bytes; the library takes it for
a space).  Null text has no ids (empty, and decodes to an empty text); extra columns are ignored; repeated
rows are encoded each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import pairs_of, trimmed, written

SPACE = "▁"
#: Stands for a literal U+2581 of the text; valid text has no lone surrogates.
_LITERAL = "\udc81"
CHUNK = 1 << 16
#: Matrices that one node of the tree combines.
FAN = 32
ENCODED = "doc_id long, text string, ids binary, chunks long"
COMPARED = "doc_id long, ids binary, chunks long, exact boolean"
#: Instead of a piece: the start of a text or a place that no piece crosses.
OPEN = -2
NONE = -1


class Vocabulary:
    def __init__(self, path: str, most_words: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.text: list[bytes | None] = []
        self.bytes = [-1] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.pieces[piece] = i
                self.rank[piece] = sp.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        if min(self.bytes) < 0:
            raise ValueError("the vocabulary has no byte pieces: texts could not be decoded exactly")
        self.longest = max(map(len, self.pieces))
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.pieces)
        self.word = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.edge = re.compile(f"(?<=[^{SPACE}]){SPACE}|\n|(?<=\n)")
        self.most = most_words
        self.known: dict[str, bytes] = {}
        self._follows: dict[tuple[str, str], bool] = {}
        #: Ids of pieces, and of other characters once they were met.
        self.code = {p: struct.pack("<I", i) for p, i in self.pieces.items()}
        #: Entries that merging can make: those that are their own encoding.
        self.sound = {p for p in self.pieces if len(self.merged(p)) == 1}

    # -- pieces -----------------------------------------------------------------------------------

    def merged(self, s: str, cut: int = 0) -> list[str] | None:
        """Pieces that merging leaves of a string; None as soon as a merge crosses ``cut``."""
        parts, rank = list(s), self.rank.get
        ends = list(range(1, len(s) + 1))
        ranks = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return parts
            if ends[at] == cut:
                return None
            parts[at] += parts.pop(at + 1)
            del ends[at], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1])

    def follows(self, a: str, b: str) -> bool:
        """Whether two sound pieces stay as they are beside each other."""
        hit = self._follows.get((a, b))
        if hit is None:
            if len(self._follows) > 2_000_000:
                self._follows.clear()
            hit = self._follows[a, b] = self.merged(a + b, len(a)) is not None
        return hit

    def width(self, part: str) -> int:
        return len(self.spell(part)) // 4

    def spell(self, part: str) -> bytes:
        hit = self.code.get(part)
        if hit is None:  # a character in no piece
            spelt = part.replace(_LITERAL, SPACE).encode()
            hit = self.code[part] = struct.pack(f"<{len(spelt)}I", *(self.bytes[b] for b in spelt))
        return hit

    # -- paths ------------------------------------------------------------------------------------

    def run(self, s: str, before: int, start: int, end: int, others: list[tuple] = ()) -> tuple[int, list[int], list[int]]:
        """(start, last, ids): for each place from ``start`` to ``end`` where the last piece begins on the only path
        to it, NONE if there is no path, and its number of ids.  The piece before ``start`` begins at ``before`` (or OPEN).

        ``others`` are runs over the same end: where this one has met one of them for a piece's length, it goes on as that one does.
        """
        longest, sound, follows = self.longest, self.sound, self.follows
        last, ids = [before], [0]
        alike = [0] * len(others)
        for q in range(start + 1, end + 1):
            found, n = NONE, 0
            for p in range(max(start, q - longest), q):
                b = last[p - start]
                if b == NONE:
                    continue
                piece = s[p:q]
                if (q - p == 1 or piece in sound) and (b == OPEN or follows(s[b:p], piece)):
                    found, n = p, ids[p - start] + self.width(piece)
                    break
            last.append(found)
            ids.append(n)
            for k, (o, its, counts) in enumerate(others):
                if q <= o:
                    continue
                same = its[q - o] == found and (found == NONE or found >= max(start, o))
                if same and found != NONE and alike[k]:
                    same = counts[q - o] - counts[found - o] == n - ids[found - start]
                alike[k] = alike[k] + 1 if same else 0
                if alike[k] > 2 * longest:
                    gaps = {ids[x - start] - counts[x - o] for x in range(q - longest, q + 1) if its[x - o] != NONE}
                    if len(gaps) < 2:
                        gap = gaps.pop() if gaps else 0
                        return start, last + its[q - o + 1 :], ids + [c + gap for c in counts[q - o + 1 :]]
        return start, last, ids

    @staticmethod
    def back(s: str, run: tuple[int, list[int], list[int]], end: int) -> list[str]:
        """Pieces of a run's path from its start to ``end``."""
        start, last, _ = run
        parts = []
        while end > start:
            p = last[end - start]
            parts.append(s[p:end])
            end = p
        return parts[::-1]

    def path(self, s: str) -> bytes:
        """Ids of a string that starts and ends at places no piece crosses: as from ``run``, by depth first search.

        Any path that reaches the end is the only one, so long pieces are tried first; pieces from which the end
        could not be reached are not tried again.
        """
        sound = self.sound
        if s in sound:
            return self.code[s]
        longest, get, follows, size = self.longest, self._follows.get, self.follows, len(s)
        pieces: list[str] = []
        dead: set[tuple[int, int]] | None = None
        at, before = 0, ""
        end = size if size < longest else longest
        while True:
            while end > at:
                piece = s[at:end]
                if (piece in sound or end == at + 1) and (dead is None or (at, end) not in dead):
                    if not before:
                        break
                    may = get((before, piece))
                    if follows(before, piece) if may is None else may:
                        break
                end -= 1
            else:
                dead = dead or set()
                dead.add((at - len(before), at))
                end = at - 1
                at -= len(pieces.pop())
                before = pieces[-1] if pieces else ""
                continue
            pieces.append(piece)
            if end == size:
                return b"".join(map(self.spell, pieces))
            at, before = end, piece
            end = at + longest
            if end > size:
                end = size

    def words(self, s: str) -> list[bytes]:
        """Ids of the words of a string that starts and ends at places no piece crosses."""
        known, words = self.known, self.word.findall(s) if self.cuts else [s]
        out = list(map(known.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    w = words[i]
                    out[i] = ids = known.get(w) or self.path(w)
                    if len(w) <= 64:
                        known[w] = ids
        if len(known) > self.most:  # common words came first; the later half goes
            for w in list(itertools.islice(known, self.most // 2, None)):
                del known[w]
        return out

    # -- chunks -----------------------------------------------------------------------------------

    def states(self, s: str, c: int) -> list[tuple[int, int]]:
        """Pieces over the character before a cut; at the start of a text there is one state."""
        if not c:
            return [(OPEN, 0)]
        size = len(s)
        return [(o, e) for o in range(max(0, c - self.longest), c) for e in range(c, min(size, o + self.longest) + 1) if e == o + 1 or s[o:e] in self.sound]

    def _edges(self, s: str, a: int, z: int) -> tuple[int, int] | None:
        """The first and last place of a chunk, its end aside, that no piece crosses."""
        if not self.cuts:
            return None
        places = [m.start() for m in self.edge.finditer(s, a, z + 1) if m.start() < z]
        return (places[0], places[-1]) if places else None

    def _leave(self, s: str, run: tuple, entry: tuple[int, int], leave: tuple[int, int], z: int) -> int:
        """Ids from an entry state, or a place no piece crosses, to an exit state along a run; NONE if it does not go there."""
        start, last, ids = run
        o, e = leave
        if entry[1] >= z:  # one piece over both ends
            return 0 if entry == leave else NONE
        if o < start or last[o - start] == NONE:
            return NONE
        b = last[o - start]
        piece = s[o:e]
        return ids[o - start] + self.width(piece) if b == OPEN or self.follows(s[b:o], piece) else NONE

    def matrix(self, s: str, a: int, z: int, final: bool) -> np.ndarray:
        """Ids from entry to exit states of the chunk ``s[a:z]``, minus infinity where no path goes; a final chunk has one exit, its end."""
        entries = self.states(s, a)
        leaves = [x for x in self.states(s, z)]
        edges = self._edges(s, a, z)
        out = np.full((len(entries), len(leaves)), -np.inf)
        if edges:
            first, final_edge = edges
            middle = sum(map(len, self.words(s[first:final_edge]))) // 4
            tail = self.run(s, OPEN, final_edge, z)
            ends = [self._leave(s, tail, (OPEN, final_edge), x, z) for x in leaves]
            for i, (o, e) in enumerate(entries):
                start, last, ids = self.run(s, o, e, first)
                if last[-1] != NONE:
                    for j, n in enumerate(ends):
                        if n != NONE:
                            out[i, j] = ids[-1] + middle + n
        else:
            runs: list[tuple] = []
            for i, (o, e) in enumerate(entries):
                runs.append(self.run(s, o, e, max(e, z), runs))
                for j, x in enumerate(leaves):
                    n = self._leave(s, runs[-1], (o, e), x, z)
                    if n != NONE:
                        out[i, j] = n
        return out.max(axis=1, keepdims=True) if final else out

    def trace(self, s: str, a: int, z: int, final: bool, entry: int, leave: int) -> tuple[bytes, str]:
        """(ids, signs) of the pieces that start in a chunk, between two states."""
        o, e = self.states(s, a)[entry]
        leaves = self.states(s, z)
        edges = self._edges(s, a, z)
        as_bytes = lambda parts: b"".join(map(self.spell, parts))
        start, before, head = e, (o, e), []
        if edges:
            head = [as_bytes(self.back(s, self.run(s, o, e, edges[0]), edges[0])), *self.words(s[edges[0] : edges[1]])]
            start, before = edges[1], (OPEN, edges[1])
        elif e >= z:
            return b"", ""
        run = self.run(s, before[0], start, z)
        if final:
            leave = next(j for j, x in enumerate(leaves) if self._leave(s, run, before, x, z) != NONE)
        o, end = leaves[leave]
        return b"".join([*head, as_bytes([*self.back(s, run, o), s[o:end]])]), s[e:end]

    # -- texts ------------------------------------------------------------------------------------

    @staticmethod
    def signs(text: str, first: bool = True) -> str:
        """The text with space signs, and one before it."""
        return (SPACE if first else "") + text.replace(SPACE, _LITERAL).replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        return b"".join(self.words(self.signs(text))) if text else b""

    def spelt(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8")

    def decode(self, ids: bytes) -> str:
        out = self.spelt(ids)
        return out[1:] if out[:1] == " " else out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: first a, then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def best_states(matrices: list[np.ndarray], entry: int = 0, leave: int = 0) -> list[int]:
    """States before, between and after the matrices of consecutive stretches on the best path from ``entry`` to ``leave``."""
    reach = np.full(len(matrices[0]), -np.inf)
    reach[entry] = 0.0
    before = [reach]
    for m in matrices[:-1]:
        before.append((before[-1][:, None] + m).max(axis=0))
    states = [leave]
    for m, r in zip(reversed(matrices), reversed(before), strict=True):
        states.append(int(np.argmax(r + m[:, states[-1]])))
    return states[::-1]


def _packed(m: np.ndarray) -> bytes:
    return struct.pack("<I", len(m)) + m.astype("<f8").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    rows, = struct.unpack_from("<I", blob)
    return np.frombuffer(blob, "<f8", offset=4).reshape(rows, -1)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _small(docs: DataFrame, path: str, chunk: int, compare: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part[1].to_pylist()]
                ids = [v.encode(t) for t in texts]
                coded, ones = pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int64())
                if compare:
                    exact = [v.decode(b) == t for b, t in zip(ids, texts, strict=True)]
                    yield pa.RecordBatch.from_arrays([part[0], coded, ones, pa.array(exact, pa.bool_())], names=["doc_id", "ids", "chunks", "exact"])
                else:
                    yield pa.RecordBatch.from_arrays([part[0], part[1], coded, ones], names=["doc_id", "text", "ids", "chunks"])

    return docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(trimmed(run), COMPARED if compare else ENCODED)


_CHUNK = "doc_id long, row long, no long, before long, n long, final boolean, signs binary"


def scanned(matrices: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """(row, no, entry, leave): the states of every chunk on its document's path, from rows (row, no, matrix).

    Up: a node's matrix is the product of its children's.  Down: a node's two states give those of its children.
    """

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        whole = reduce(combine, map(_unpacked, table["matrix"].to_pylist()))
        return pa.table({"row": table["row"][:1], "no": pa.array([table["no"][0].as_py() // fan], pa.int64()), "matrix": pa.array([_packed(whole)], pa.binary())})

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        states = best_states(list(map(_unpacked, table["matrix"].to_pylist())), table["entry"][0].as_py(), table["leave"][0].as_py())
        return pa.table({"row": table["row"], "no": table["no"], "entry": pa.array(states[:-1], pa.int64()), "leave": pa.array(states[1:], pa.int64())})

    node = F.floor(F.col("no") / fan).alias("node")
    tree = [matrices]
    for _ in range(levels):
        tree.append(written(tree[-1].groupBy("row", node).applyInArrow(up, "row long, no long, matrix binary"), "spans"))
    states = tree.pop().select("row", "no", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("leave"))
    for level in reversed(tree):
        above = states.withColumnRenamed("no", "node")
        states = level.withColumn("node", node).join(above, ["row", "node"]).groupBy("row", "node").applyInArrow(down, "row long, no long, entry long, leave long")
    return states


def _giant(docs: DataFrame, path: str, chunk: int, compare: bool) -> DataFrame:
    """Each chunk is a row that carries its place and the characters around it that a piece may reach.

    The chunks and their matrices are tables: a row's number is given once, whatever is computed again later.
    """
    giant = docs.where(F.length("text") > chunk).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = vocabulary(path).longest
        for batch in batches:
            for doc, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Vocabulary.signs(text)
                for no, a in enumerate(range(0, len(s), chunk)):
                    lo, z = max(0, a - reach), min(len(s), a + chunk)
                    part = s[lo : z + reach].encode("utf-8", "surrogatepass")
                    values = (doc, row, no, a - lo, z - a, z == len(s), part)
                    kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["doc_id", "row", "no", "before", "n", "final", "signs"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            blobs = [_packed(v.matrix(s.decode("utf-8", "surrogatepass"), a, a + n, final)) for a, n, final, s in zip(*(batch[c].to_pylist() for c in ("before", "n", "final", "signs")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["no"], pa.array(blobs, pa.binary())], names=["row", "no", "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids, texts, exact = [], [], []
            for no, a, n, final, s, entry, leave in zip(*(batch[c].to_pylist() for c in ("no", "before", "n", "final", "signs", "entry", "leave")), strict=True):
                s = s.decode("utf-8", "surrogatepass")
                mine, signs = v.trace(s, a, a + n, final, entry, leave)
                signs = signs.replace(SPACE, " ").replace(_LITERAL, SPACE)
                ids.append(mine)
                exact.append(v.spelt(mine) == signs)
                texts.append(None if compare else signs[1:] if no == 0 else signs)
            cols = [pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["no"], *cols], names=["doc_id", "row", "no", "ids", "part", "exact"])

    chunks = written(giant.mapInArrow(trimmed(split), _CHUNK), "chunks")
    levels, most = 0, (chunks.agg(F.max("no")).first()[0] or 0) + 1
    while FAN**levels < most:
        levels += 1
    if levels:
        solved = written(chunks.repartition("row", "no").mapInArrow(trimmed(matrices), "row long, no long, matrix binary"), "matrices")
        states = scanned(solved, levels)
    else:
        states = chunks.select("row", "no", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("leave"))
    traced = chunks.join(states, ["row", "no"]).mapInArrow(trimmed(trace), "doc_id long, row long, no long, ids binary, part string, exact boolean")
    parts = F.array_sort(F.collect_list(F.struct("no", "ids", "part")))
    whole = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), parts.alias("parts"), F.every("exact").alias("exact"))
    ids = F.unhex(F.concat_ws("", F.transform("parts", lambda x: F.hex(x["ids"])))).alias("ids")
    count = F.size("parts").cast("long").alias("chunks")
    if compare:
        return whole.select("doc_id", ids, count, "exact")
    return whole.select("doc_id", F.concat_ws("", F.col("parts.part")).alias("text"), ids, count)


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, compare: bool = False) -> DataFrame:
    """(doc_id, text, ids, chunks): ids as unsigned little-endian 32-bit numbers.

    With ``compare`` the ids are decoded again at once and ``exact`` tells whether they give the text, which then stays out.
    """
    rows = pairs_of(docs, id_col, text_col)
    return _small(rows, model_path, chunk, compare).union(_giant(rows, model_path, chunk, compare))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [v.decode(b) for b in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(trimmed(run), f"{ENCODED}, decoded string")
