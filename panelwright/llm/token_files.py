"""Token-id files: ids of whole texts, Re-Pair compressed in shards, random access by document.

Documents are dealt to partitions by ranges of doc_id and sorted; a partition is cut into shards
of about SHARD_IDS ids.  In a shard the frequent pairs of neighbouring ids are replaced by new
symbols, round after round (each round takes the most frequent pairs that do not overlap), until
no pair is found LEAST_COUNT times.  A
file row is a shard: first symbol number, rules, the number of ids each rule expands to, the
symbol sequence, and per document its id, first symbol and number of ids.  A document's ids are
those of a range of whole symbols, because no pair spans two documents.  The files are Parquet
with binary columns, written and committed by Spark.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

END_ID = 1
SHARD_IDS = 1 << 20
#: A shard also ends at so many documents, so that empty texts cannot fill one without end.
SHARD_DOCS = 1 << 16
RULES_A_ROUND, LEAST_COUNT = 2048, 8
#: Bits of the table in which pairs are counted.
COUNT_BITS = 20
#: Bytes of text that are encoded together, about (a longer text alone), and pieces of one call of the library.
TEXT_BYTES, PIECES_A_CALL = 3_000_000, 50_000
FILE_SCHEMA = "part int, shard int, n_docs int, n_ids long, first_symbol int, rules binary, lengths binary, symbols binary, doc_ids binary, doc_null binary, doc_symbols binary, doc_lengths binary"


#: The tokenizer's settings under which words may be cut into pieces here.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = regex.compile(r"[\x21-\u012f\u0131-\u024f]+")
#: Words of Latin letters with at most one of a few signs behind them: one piece, or two.
SIMPLE = r"^[a-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+[.,;:!?]?$"
MARKED = r"[.,;:!?]$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others, in order, for those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


def cut_by_pieces(tokenizer) -> bool:
    """Whether normalizer, pre-tokenizer and model are those that ``TextIds.word_ids`` knows."""
    j = json.loads(tokenizer.to_str())
    steps = [n.get("type") for n in (j["normalizer"] or {}).get("normalizers", [])]
    before = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and len(before) == 2 and before[0].get("pattern") == {"Regex": PIECES} and before[0].get("invert") is True and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space") and bool(j["model"].get("end_of_word_suffix"))


class TextIds:
    """Ids of texts, by the tokenizers library.

    The tokenizer never joins text across white space (its pattern drops it), so a text's ids are
    those of its words: Arrow splits the texts and numbers their distinct words.  Words of Latin
    letters, digits and signs are cut into the tokenizer's pieces here, and the distinct pieces go
    through the library's BPE model, thousands in one call; all other words go through whole
    calls.  Nothing is kept from one batch to the next.  A test holds the ids against whole calls."""

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.cut = tokenizer, None
        self.first_symbol = tokenizer.get_vocab_size(with_added_tokens=True)
        if cut_by_pieces(tokenizer):
            self.cut, self.model = regex.compile(PIECES), Tokenizer(tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            self.letters = dict(enumerate(byte_letters())) | {32: " "}
            self.ends = np.zeros(self.first_symbol, bool)
            self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by text) by whole calls."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by piece): a piece's last id is one that ends a word."""
        out = [np.empty(0, np.uint32)]
        for at in range(0, len(pieces), PIECES_A_CALL):
            line = " ".join(pieces[at : at + PIECES_A_CALL])
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.letters)
            out.append(np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(out)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(pieces) or int(sizes.sum()) != len(ids):
            raise ValueError("the tokenizer's pieces and their ids differ in number")
        return ids, sizes

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number by word) of distinct words whose A-Z are lower-cased."""
        simple = pc.match_substring_regex(words, SIMPLE).to_numpy(zero_copy_only=False)
        own = pc.utf8_lower(words.filter(pa.array(simple)))
        marked = pc.match_substring_regex(own, MARKED).to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(own, 0, -1), own)
        marks = pc.utf8_slice_codeunits(own.filter(pa.array(marked)), -1, None)
        cut_at, cut_sizes, cut, odd_at, odd = [], [], [], [], []
        for i in np.flatnonzero(~simple).tolist():
            w = words[i].as_py()
            if w.isascii() or PLAIN.fullmatch(w) and unicodedata.is_normalized("NFC", w):
                low = w.lower()
                if low.isprintable():
                    found = self.cut.findall(low)
                    cut_at.append(i), cut_sizes.append(len(found)), cut.extend(found)
                    continue
            odd_at.append(i), odd.append(w)
        every = pa.concat_arrays([stems, marks, pa.array(cut, words.type)]).dictionary_encode()
        ids, sizes = self.piece_ids(every.dictionary.to_pylist())
        more, more_sizes = self.whole(odd)
        number = every.indices.to_numpy()
        # a word's pieces one after the other; an odd word is a piece of its own
        count = np.zeros(len(words), np.int64)
        count[simple], count[cut_at], count[odd_at] = 1 + marked, cut_sizes, 1
        start = np.cumsum(count) - count
        piece = np.empty(int(count.sum()), np.int64)
        first, n, m = start[simple], len(stems), len(marks)
        piece[first], piece[first[marked] + 1] = number[:n], number[n : n + m]
        piece[gathered(start[cut_at], np.array(cut_sizes, np.int64))] = number[n + m :]
        piece[start[odd_at]] = len(sizes) + np.arange(len(odd))
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, more_sizes])
        begin, size = (np.cumsum(sizes) - sizes)[piece], sizes[piece]
        reach = np.concatenate([[0], np.cumsum(size)])
        return ids[gathered(begin, size)], reach[start + count] - reach[start]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by end_id; number of ids of each text, that one included)."""
        # special tokens are looked for before lower-casing, and may stand inside words
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.cut else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        if self.cut:
            ids, sizes = self.word_ids(words.dictionary)
        else:
            ids, sizes = np.empty(0, np.uint32), np.zeros(len(words.dictionary), np.int64)
        number = words.indices.to_numpy()
        begin, size = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ids = ids[gathered(begin, size)]
        reach = np.concatenate([[0], np.cumsum(size)])[bounds - bounds[0]]
        counts, starts = np.diff(reach), reach[:-1]
        if special.any():
            more, more_counts = self.whole(texts.filter(pa.array(special)).to_pylist())
            starts[special], counts[special] = len(ids) + np.cumsum(more_counts) - more_counts, more_counts
            ids = np.concatenate([ids, more])[gathered(starts, counts)]
        return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


_TOKENIZERS: dict[str, TextIds] = {}


def text_ids(tokenizer_file: str) -> TextIds:
    """The tokenizer of this Python worker; a worker runs many tasks, one at a time."""
    if tokenizer_file not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[tokenizer_file] = TextIds(Tokenizer.from_file(tokenizer_file))
    return _TOKENIZERS[tokenizer_file]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + size) one after the other."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    full = sizes > 0
    s, n = starts[full], sizes[full]
    if not len(s):
        return out[:0]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def frequent_pairs(a: np.ndarray, b: np.ndarray, slot: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of pairs (a, b) with their hash slots and the slots' counts: (positions, index of the pair at each, pairs), for the
    RULES_A_ROUND or fewer pairs that are counted LEAST_COUNT times or more, exactly, in the heaviest slots.  None only if no
    pair at all is."""
    heavy = np.flatnonzero(counts >= LEAST_COUNT)
    top = heavy[np.argpartition(-counts[heavy], RULES_A_ROUND)[:RULES_A_ROUND]] if len(heavy) > RULES_A_ROUND else heavy
    for own in (top, heavy) if len(top) < len(heavy) else (top,):
        rank = np.full(len(counts), -1, np.int32)
        rank[own] = np.arange(len(own))
        which = rank[slot]
        at = np.flatnonzero(which >= 0)
        which, k = which[at], (a[at].astype(np.int64) << 32) | b[at]
        # one pair of each slot is counted by the slot, the few that share it with another by sorting
        pairs = np.empty(len(own), np.int64)
        pairs[which] = k
        other = np.flatnonzero(pairs[which] != k)
        more, place = np.unique(k[other], return_inverse=True)
        which[other] = len(own) + place
        pairs = np.concatenate([pairs, more])
        n = np.bincount(which, minlength=len(pairs))
        good = np.flatnonzero(n >= LEAST_COUNT)
        if len(good):
            if len(good) > RULES_A_ROUND:
                good = good[np.argpartition(-n[good], RULES_A_ROUND)[:RULES_A_ROUND]]
            new = np.full(len(pairs), -1, np.int32)
            new[good] = np.arange(len(good))
            which = new[which]
            return at[which >= 0], which[which >= 0], pairs[good]
    return None


def re_pair(ids: np.ndarray, end_id: int, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, ids each rule expands to).  Symbols from ``first_symbol`` on are
    rules; pairs with ``end_id`` are left alone, so no symbol spans two documents.  Rounds go on
    until no pair of neighbours is counted LEAST_COUNT times.

    A pair's count only falls from round to round, except where a new symbol stands, so a place
    whose pair is rare is looked at again only once a neighbour is replaced."""
    seq, rules = ids.astype(np.uint32), np.empty((0, 2), np.int64)
    alive = np.zeros(len(seq), bool)  # places whose pair with the next may be frequent
    alive[:-1] = (seq[:-1] != end_id) & (seq[1:] != end_id)
    while True:
        free = np.flatnonzero(alive)
        a, b = seq[free], seq[free + 1]
        slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - COUNT_BITS)
        counts = np.bincount(slot, minlength=1 << COUNT_BITS)
        often = counts[slot] >= LEAST_COUNT
        alive[free[~often]] = False
        free, a, b, slot = free[often], a[often], b[often], slot[often]
        found = frequent_pairs(a, b, slot, counts)
        if found is None:
            break
        at, which, pairs = free[found[0]], found[1], found[2]
        # of overlapping occurrences (neighbouring positions), every second one of a run is taken
        breaks = np.concatenate([[True], np.diff(at) != 1])
        run_start = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - run_start) % 2 == 0
        at, which = at[chosen], which[chosen]
        # a rule that too few occurrences are left to waits for a later round
        uses = np.bincount(which, minlength=len(pairs))
        kept = uses >= (LEAST_COUNT // 2 if uses.max() >= LEAST_COUNT // 2 else 1)
        own = kept[which]
        at, which = at[own], (np.cumsum(kept) - 1)[which[own]]
        seq[at] = first_symbol + len(rules) + which
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, alive = seq[keep], alive[keep]
        at = at - np.arange(len(at))
        near = np.concatenate([at, at[at > 0] - 1])
        near = near[near < len(seq) - 1]
        alive[near] = (seq[near] != end_id) & (seq[near + 1] != end_id)
        alive[-1] = False
        rules = np.concatenate([rules, np.stack([pairs[kept] >> 32, pairs[kept] & 0xFFFFFFFF], 1)])
    lengths = [1] * len(rules)
    for k, (x, y) in enumerate(rules.tolist()):
        lengths[k] = (lengths[x - first_symbol] if x >= first_symbol else 1) + (lengths[y - first_symbol] if y >= first_symbol else 1)
    return seq, rules.astype(np.uint32), np.array(lengths, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids of a sequence of symbols."""
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    flat = np.empty(int(lengths.sum(dtype=np.int64)), np.uint32)
    # rules of one depth together: their parts are ids or rules of less depth
    depth = np.zeros(len(rules), np.int64)
    deep: list[int] = []
    for x, y in rules.tolist():
        deep.append(1 + max(deep[x - first_symbol] if x >= first_symbol else 0, deep[y - first_symbol] if y >= first_symbol else 0))
    depth[:] = deep
    for d in range(1, int(depth.max(initial=0)) + 1):
        level = np.flatnonzero(depth == d)
        to = starts[level]
        for part in (rules[level, 0], rules[level, 1]):
            rule = part >= first_symbol
            flat[to[~rule]] = part[~rule]
            r = part[rule] - first_symbol
            flat[gathered(to[rule], lengths[r].astype(np.int64))] = flat[gathered(starts[r], lengths[r].astype(np.int64))]
            size = np.ones(len(level), np.int64)
            size[rule] = lengths[r]
            to = to + size
    # plain ids are looked up behind the rules' expansions, one each
    is_rule = symbols >= first_symbol
    source = np.concatenate([flat, symbols[~is_rule].astype(np.uint32)])
    sizes, begin = np.ones(len(symbols), np.int64), np.empty(len(symbols), np.int64)
    r = symbols[is_rule].astype(np.int64) - first_symbol
    sizes[is_rule], begin[is_rule] = lengths[r], starts[r]
    begin[~is_rule] = len(flat) + np.arange(int((~is_rule).sum()))
    return source[gathered(begin, sizes)]


def document_ids(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, decoding only its own symbols."""
    symbols, per = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["doc_symbols"], "<u4")
    at = int(per[:k].sum())
    return expand(symbols[at : at + per[k]].astype(np.int64), np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(row["lengths"], "<u4"), row["first_symbol"])


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text (null: empty) and write the shards, in ascending doc_id order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = text_ids(tokenizer_file)
        first = tokenizer.first_symbol
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            ids, sizes, doc_ids, null = (np.concatenate(c) for c in zip(*held))
            symbols, rules, lengths = re_pair(ids, end_id, first)
            ends = np.flatnonzero(symbols == end_id)
            if len(ends) != len(sizes):  # the end id also stands inside texts
                reach = np.cumsum(np.where(symbols >= first, lengths[np.maximum(symbols.astype(np.int64) - first, 0)] if len(lengths) else 1, 1))
                ends = np.searchsorted(reach, np.cumsum(sizes))
            values = [part, shard, len(sizes), int(sizes.sum()), first, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), np.diff(ends, prepend=-1).astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 7
            shard, held = shard + 1, []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        n = docs_held = 0
        for batch in batches:
            texts, doc_ids = batch.column(1), batch.column(0)
            null = doc_ids.is_null().to_numpy(zero_copy_only=False)
            numbers = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
            reach = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                to = at + 1 + int(np.searchsorted(reach[at + 1 :], (reach[at - 1] if at else 0) + TEXT_BYTES, side="right"))
                ids, sizes = tokenizer.encode(texts.slice(at, to - at), end_id)
                ends, k = np.cumsum(sizes), 0
                while k < len(sizes):
                    start = int(ends[k - 1]) if k else 0
                    m = min(k + 1 + int(np.searchsorted(ends[k:], start + shard_ids - n)), k + SHARD_DOCS - docs_held, len(sizes))
                    held.append((ids[start : ends[m - 1]], sizes[k:m], numbers[at + k : at + m], null[at + k : at + m]))
                    n, docs_held, k = n + int(ends[m - 1]) - start, docs_held + m - k, m
                    if n >= shard_ids or docs_held >= SHARD_DOCS:
                        yield close()
                        n = docs_held = 0
                at = to
        if held:
            yield close()

    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in any row order."""
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)
    heads = shards.select("part", "shard", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = Window.partitionBy("part").orderBy("shard")
    starts = heads.join(parts, "part").select("part", "shard", (F.col("part_start") + F.sum("n_ids").over(own) - F.col("n_ids")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
                ids = expand(np.frombuffer(row["symbols"], "<u4").astype(np.int64), rules, np.frombuffer(row["lengths"], "<u4"), row["first_symbol"]).astype("<u4")
                sizes = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != row["n_ids"] or len(ids) != ends[-1]:
                    raise ValueError(f"shard {row['part']}/{row['shard']} does not expand to its length")
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["doc_null"], "u1").astype(bool))
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.full(m, row["part"]), pa.int32()), pa.array(np.full(m, row["shard"]), pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "part", "shard", "inner", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "doc_id long, part int, shard int, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read them back.

    Null and empty texts are the end id alone; null ids come first; rows that repeat an id stand
    side by side in an order by their text's hash, one result row each; very long texts are encoded whole; other columns are
    ignored; an empty table gives no rows."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_file or tokenizer_path())
    return read_token_files(docs.sparkSession, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
