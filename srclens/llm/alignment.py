"""Alignment of two tokenizers by pointer jumping over overlapping tokens.

Both tokenizers cut the bytes of space + text.  Every token points to its
farthest-right overlapping token (itself, if none reaches further); doubling of
the pointers, vectorised over many texts, ends at the last token of each
component, whose end labels a group.

Neither tokenizer has a token that crosses the start of a run of spaces or line
feeds after another character, so a text is cut there into units, and a unit is
tokenized and aligned once per worker for as long as it is remembered.  Blocks of
documents ask the corpus for the counts of their own id pairs, so no table of
pairs is broadcast and a document's links are never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import bounded_batches, prefix_sums, substrings, table, text_bytes, written

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 6 << 20  # texts that share a block's pairs; a longer text is a block of its own
MOST_KEPT = 400_000  # units a worker remembers
B_BITS = 20  # of a pair's code

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text begins, or a space or line feed follows a character that is not white."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = (data == 0x20) | (data == 0x0A)
    before = np.concatenate([data[:1], data[:-1]])
    cut &= ~_WHITE[before]
    # Characters beyond ASCII: those in whose block a white one lies do not cut.
    second = np.concatenate([data[:2], data[:-2]])[:len(data)]
    third = np.concatenate([data[:3], data[:-3]])[:len(data)]
    wide = (third == 0xE1) & (second == 0x9A) | (third == 0xE2) & ((second == 0x80) | (second == 0x81)) | (
        third == 0xE3) & (second == 0x80)
    cut &= ~((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) & ~(wide & (before >= 0x80))
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def _byte_of() -> dict[str, int]:
    """The byte behind each printable stand-in of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The end of the last token of each token's component: first A's, then B's tokens.

    Both rows of tokens cover the same bytes without gaps.
    """
    ends = np.concatenate([a_ends, b_ends])
    over_a = len(a_ends) + np.searchsorted(b_ends, a_ends)  # the other token over this one's last byte
    over_b = np.searchsorted(a_ends, b_ends)
    other = np.concatenate([over_a, over_b])
    to = np.where(ends[other] > ends, other, np.arange(len(ends)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return ends[to]
        to = further


class Aligner:
    """Two tokenizers and the aligned units that a worker remembers."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte = _byte_of()
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        a_bytes = [b""] * size
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = (a_bytes, b_bytes)
        self.sizes = tuple(np.array([len(x) for x in t], np.int64) for t in self.bytes)
        self.names = tuple(np.array([[b"%d" % i + mark for mark in marks] for i in range(len(t))], object)
                           for t, marks in zip(self.bytes, ((b",", b"|"), (b",", b";"))))
        self._keep(np.zeros(0, np.int64), fresh=True)

    def _keep(self, which: np.ndarray, fresh: bool = False) -> None:
        """Remember only some of the units."""
        if fresh:
            self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.facts = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether bytes differ
            self.text = np.zeros(0, object)
            self.first, self.code, self.many = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
            return
        take, self.first = _ranges(self.first[which], self.first[which + 1])
        self.code, self.many = self.code[take], self.many[take]
        self.keys, self.used, self.facts, self.text = (x[which] for x in (self.keys, self.used, self.facts, self.text))

    def _ids(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        texts = [u.decode("utf-8", "replace") for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a space before its input: the unit's own first one, or one that is taken away again.
        own = [t[:1] == " " for t in texts]
        b = self.b.encode([t[1:] if o else t for t, o in zip(texts, own)], num_threads=1)
        space = self.b.piece_to_id("▁")
        b = [ids if o else ids[1:] if ids[:1] == [space] else [] for ids, o in zip(b, own)]
        # An empty input has no piece at all, but the unit is its space.
        return a, [[space] if t == " " else ids for ids, t in zip(b, texts)]

    def _learn(self, keys: np.ndarray, units: list[bytes]) -> None:
        flat, counts, alike = [], [], []
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        for ids, names, sizes in zip(self._ids(units), self.bytes, self.sizes):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())))
            counts.append(n)
            whole = np.add.reduceat(np.append(sizes[flat[-1]], 0), np.minimum(np.cumsum(n) - n, len(flat[-1])))
            same = (np.where(n > 0, whole, 0) == lengths)
            if not same.all() or b"".join([names[i] for i in flat[-1].tolist()]) != b"".join(units):
                same = np.array([b"".join([names[i] for i in x]) == u for x, u in zip(ids, units)], bool)
            alike.append(same)
        good = alike[0] & alike[1]
        unit_of = [np.repeat(np.arange(len(units)), n) for n in counts]
        flat = [f[good[u]] for f, u in zip(flat, unit_of)]
        unit_of = [u[good[u]] for u in unit_of]
        ends = [np.cumsum(s[f]) for s, f in zip(self.sizes, flat)]
        label = jump(*ends)
        group_ends, group = np.unique(label, return_inverse=True)
        group = (group[:len(flat[0])], group[len(flat[0]):])
        per = [np.bincount(g, minlength=len(group_ends)) for g in group]
        group_unit = np.zeros(len(group_ends), np.int64)
        group_unit[group[0]] = unit_of[0]
        facts = np.zeros((len(units), 5), np.int64)
        for column, (of, weight) in enumerate([(unit_of[0], None), (unit_of[1], None), (group_unit, None),
                                               (group_unit, per[0] * per[1])]):
            facts[:, column] = np.bincount(of, weight, minlength=len(units))
        facts[:, 4] = ~good
        # Every A token of a group with every B token of it.
        b_first = np.cumsum(per[1]) - per[1]
        at, bounds = _ranges(b_first[group[0]], b_first[group[0]] + per[1][group[0]])
        code = (np.repeat(flat[0], np.diff(bounds)) << B_BITS) | flat[1][at]
        of = np.repeat(unit_of[0], np.diff(bounds))
        order = np.lexsort((code, of))
        code, of = code[order], of[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
        many = np.diff(np.append(np.flatnonzero(new), len(code))).astype(np.int32)
        code, of = code[new], of[new]
        # `a1,a2|b1;` of each group, in order.
        last = [np.append(g[1:] != g[:-1], True).astype(np.int64) if len(g) else g for g in group]
        names = np.concatenate([n[f, z] for n, f, z in zip(self.names, flat, last)]) if len(flat[0]) else np.zeros(0, object)
        names = names[np.lexsort((np.repeat([0, 1], [len(g) for g in group]), np.concatenate(group)))].tolist()
        stops = np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        text = np.empty(len(units), object)
        text[:] = [b"".join(names[s:e]) for s, e in zip([0, *stops], stops)]
        # In the order of keys.
        place = np.searchsorted(self.keys, keys)
        links, _ = _ranges(self.first[:-1], self.first[1:])
        old, fresh = np.diff(self.first), np.bincount(of, minlength=len(units))
        sizes = np.insert(old, place, fresh)
        is_new = np.insert(np.zeros(len(old), bool), place, True)
        from_new = np.repeat(is_new, sizes)
        code_all, many_all = np.empty(len(from_new), np.int64), np.empty(len(from_new), np.int32)
        code_all[from_new], code_all[~from_new] = code, self.code[links]
        many_all[from_new], many_all[~from_new] = many, self.many[links]
        self.code, self.many, self.first = code_all, many_all, np.concatenate([[0], np.cumsum(sizes)])
        self.keys, self.used = np.insert(self.keys, place, keys), np.insert(self.used, place, 0)
        self.facts, self.text = np.insert(self.facts, place, facts, axis=0), np.insert(self.text, place, text)

    def units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Remembered units of some texts, and for each unit in order which of them it is."""
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(substrings(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_KEPT:  # the more used half stays
            self._keep(np.sort(np.argsort(-self.used, kind="stable")[:MOST_KEPT // 2]))
            self.used >>= 1
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            raw, new = data.tobytes(), first[~known]
            self._learn(keys[~known], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.keys, keys)
        self.used[at] += np.bincount(which, minlength=len(at))
        return at, which


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges one after the other, and the bounds of each range there."""
    size = stops - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size), bounds


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    import os

    if (a, b) not in _aligners:
        import public_tokenizers

        _aligners[a, b] = Aligner(*(x if os.path.isabs(x) else public_tokenizers.path(x) for x in (a, b)))
    return _aligners[a, b]


BLOCKS = ("block long, is_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
          "groups_sha256 string, units binary, pairs array<long>, held array<long>, first binary, link binary, many binary")
_FIELDS = pa.schema([
    ("block", pa.int64()), ("is_block", pa.bool_()), *((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups_sha256", pa.string()), ("units", pa.binary()), ("pairs", pa.list_(pa.int64())),
    ("held", pa.list_(pa.int64())), ("first", pa.binary()), ("link", pa.binary()), ("many", pa.binary())])


def _block(known: Aligner, number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
    """Rows of a block's documents, and one row of its units' links and its pairs."""
    texts = [b" " + t if t else b"" for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = unit_starts(data, offsets)
    at, which = known.units(data, starts)
    bounds = np.searchsorted(starts, offsets)
    facts = known.facts[at][which]
    sums = np.zeros((len(facts) + 1, 5), np.int64)
    np.cumsum(facts, axis=0, out=sums[1:])
    per = np.diff(sums[bounds], axis=0)
    per[per[:, 4] > 0, :4] = 0  # bytes differ: no tokens
    names = known.text[at][which]
    counted = per[:, 0] > 0
    hashes = [hashlib.sha256(b"".join(names[s:e].tolist())[:-1]).hexdigest() if c else ""
              for s, e, c in zip(bounds.tolist(), bounds[1:].tolist(), counted.tolist())]
    sequence = which.astype(np.uint32)
    units = [sequence[s:e].tobytes() if c else b"" for s, e, c in zip(bounds.tolist(), bounds[1:].tolist(), counted.tolist())]
    # How many documents of the block hold each pair.
    links, first = _ranges(known.first[at], known.first[at + 1])
    pairs, link = np.unique(known.code[links], return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = counted[doc]
    held = np.unique(doc[keep] * (len(at) + 1) + which[keep])
    doc, unit = held // (len(at) + 1), held % (len(at) + 1)
    places, ends = _ranges(first[unit], first[unit + 1])
    held = np.unique(np.repeat(doc, np.diff(ends)) * (len(pairs) + 1) + link[places])
    held = np.bincount(held % (len(pairs) + 1), minlength=len(pairs))
    n, alone = len(texts), [None] * len(texts)
    columns = [
        [number] * (n + 1), [False] * n + [True], [*ids, None],
        *([*per[:, i].tolist(), None] for i in range(4)), [*hashes, None], [*units, None],
        [*alone, pairs], [*alone, held], [*alone, first.astype(np.uint32).tobytes()],
        [*alone, link.astype(np.uint32).tobytes()], [*alone, known.many[links].astype(np.uint32).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def blocks(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks of bounded bytes, with their groups, links and units."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(a, b), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            for i, s, e in zip(batch.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                if ids and size + e - s > block_bytes:
                    yield _block(known, number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(raw[s:e])
                size += e - s
        if ids:
            yield _block(known, number, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def _sum_up(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """Per document of a block: links whose pair is its A id's best, and the sum of counts."""
    block, docs = rows.filter(rows.column("is_block")), rows.filter(pc.invert(rows.column("is_block")))
    pairs = block.column("pairs").combine_chunks().flatten().to_numpy()
    first, link, many = (np.frombuffer(block.column(n)[0].as_py(), np.uint32).astype(np.int64)
                         for n in ("first", "link", "many"))
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.searchsorted(pairs, answers.column("pair").to_numpy())
    count[at] = answers.column("docs").to_numpy()
    best[at] = answers.column("is_best").to_numpy()
    sums = []
    for value in (best, count):
        total = np.concatenate([[0], np.cumsum(value[link] * many)])
        unit = total[first[1:]] - total[first[:-1]]
        sums.append([int(unit[np.frombuffer(u.as_py(), np.uint32)].sum()) for u in docs.column("units")])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table([docs.column(n) for n in names] + [pa.array(s, pa.int64()) for s in sums] + [docs.column("groups_sha256")],
                    names=[*names, "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, docs, is_best): documents that hold an id pair linked, and whether no pair of its A id is in more."""
    counts = written(blocks.where("is_block").select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
                     .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("docs")).where("docs > 0"))
    a_id = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a_id", a_id).join(most, "a_id").select(
        "pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("is_best"))


def align(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): tokens, groups, links and how common the links are.

    ``a`` is a byte-level file of ``tokenizers``, ``b`` a BPE model of ``sentencepiece``
    that adds a space; none of b's pieces may hold a space or line feed after another
    character.  Null and empty texts, and those whose tokens do not join to the text's
    bytes, have zeros and an empty hash and hold no pair.  Repeated rows are documents
    of their own; a null doc_id is kept; other columns are not read.
    """
    rows = written(blocks(docs, a, b, block_bytes))
    asked = rows.where("is_block").select(F.col("block").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(rows), "pair")
    return rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(
        _sum_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                 "n_best long, count_sum long, groups_sha256 string")


def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_pointer_jumping": op11_pointer_jumping}
ORACLES: dict[str, str] = {}
