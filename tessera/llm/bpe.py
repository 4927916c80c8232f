"""Byte-level BPE over a whole corpus with Spark higher-order functions.

The corpus is cut into pieces once, with the tokenizer's pattern. A piece that is a token as a whole
(most are) gets its id in its document, from a literal table of the vocabulary. The distinct other
pieces are encoded once by folding ranked merges over their byte ids, and their ids go back to the
places they were taken from. The tables are literals in the plan: two-choice (cuckoo) hash tables
packed into arrays, whose size depends on the vocabulary alone, never on the data.

A piece is first cut where two neighbouring bytes stand together in no token: no merge can cross
that place. What is longer than LONG bytes after that (runs of one sign, say) is merged in rounds
that take all places of a pair at once; the result is the same.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import xxhash

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, ensure_checkpoint_dir, parallelism, spread

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's pattern, with white space spelt as the Unicode property for Java.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
SLOT_BITS = 16
ID_BITS = 16
MULTIPLIERS = (1640531527, 1540483477)
SHIFTS = (16, 16)
NO_MERGE = 1 << ID_BITS
EMPTY = 1 << 62  # of a slot: no key's bits make it less than NO_MERGE
SEPARATOR = "\ue000"  # stands in no token
LONG = 256


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) to merged id: the last merge that builds each token from its bytes."""
    pairs = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            pairs[ranks[parts[0]], ranks[parts[1]]] = rank
    return pairs


def _slots(key: int) -> tuple[int, int]:
    mask = (1 << SLOT_BITS) - 1
    first, second = (((key * m) >> s) & mask for m, s in zip(MULTIPLIERS, SHIFTS, strict=True))
    return first, second + mask + 1


def _cuckoo(entries: list, slots_of, size: int, empty) -> list:
    """Entries in a two-choice table: each is in one of its two slots."""
    table = [empty] * size
    for entry in entries:
        slot = slots_of(entry)[0]
        for _ in range(500):
            table[slot], entry = entry, table[slot]
            if entry == empty:
                break
            a, b = slots_of(entry)
            slot = b if slot == a else a
        else:
            raise ValueError("the table does not fit its slots")
    return table


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[int, ...]:
    """The merges as a cuckoo table: each entry is key << ID_BITS | merged id."""
    entries = [((left << ID_BITS | right) << ID_BITS) | merged for (left, right), merged in merge_pairs(load_ranks(path)).items()]
    return tuple(_cuckoo(entries, lambda e: _slots(e >> ID_BITS), 2 << SLOT_BITS, EMPTY))


def _token_slots(token: str) -> tuple[int, int]:
    mask, h = (1 << SLOT_BITS) - 1, xxhash.xxh64_intdigest(token.encode(), 42)
    return h & mask, (h >> 32 & mask) + mask + 1


@lru_cache(maxsize=4)
def token_table(path: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """The tokens that are whole texts, and their ids, as a cuckoo table by their hash."""
    ranks: dict[str, int] = {}
    for token, rank in load_ranks(path).items():
        try:
            ranks[token.decode()] = rank
        except UnicodeDecodeError:
            continue
    if any(SEPARATOR in t for t in ranks):
        raise ValueError("the separator stands in a token")
    table = _cuckoo(sorted(ranks, key=lambda t: -ranks[t]), _token_slots, 2 << SLOT_BITS, "")  # frequent tokens come last and keep their first slot
    return tuple(table), tuple(ranks.get(t, -1) for t in table)


@lru_cache(maxsize=4)
def neighbours(path: str) -> tuple[int, ...]:
    """Bits, 32 in each entry: whether some token holds the bytes of two byte ids side by side."""
    ranks = load_ranks(path)
    of = [ranks[bytes([b])] for b in range(256)]
    out = [0] * 2048
    for token in ranks:
        for a, b in zip(token, token[1:], strict=False):
            at = of[a] << 8 | of[b]
            out[at >> 5] |= 1 << (at & 31)
    return tuple(out)


def _literal_array(values, kind: str = "bigint") -> Column:
    """An array literal: the optimiser folds the cast, so rows share one object."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def whole_tokens(pieces: Column, vocab_path: str = DEFAULT_VOCAB) -> Column:
    """For each piece the id of the token that it is as a whole, else -1."""
    tokens, ids = token_table(vocab_path)
    mask = (1 << SLOT_BITS) - 1

    def one(piece: Column, texts: Column, numbers: Column) -> Column:
        first = F.xxhash64(piece).bitwiseAND(F.lit(mask)).cast("int")
        second = (F.shiftrightunsigned(F.xxhash64(piece), 32).bitwiseAND(F.lit(mask)) + F.lit(mask + 1)).cast("int")
        return F.when(F.get(texts, first) == piece, F.get(numbers, first)).when(F.get(texts, second) == piece, F.get(numbers, second)).otherwise(F.lit(-1))

    # Each table stands in the plan once.
    texts, numbers = F.split(F.lit(SEPARATOR.join(tokens)), SEPARATOR), _literal_array(ids, "int")
    return _let(texts, lambda t: _let(numbers, lambda n: F.transform(pieces, lambda p: one(p, t, n))))


def encode_piece(piece: Column, vocab_path: str = DEFAULT_VOCAB) -> Column:
    """The ids of one non-empty piece: a fold that applies the lowest-ranked merge until none is left."""
    ranks = load_ranks(vocab_path)
    if sorted(ranks[bytes([b])] for b in range(256)) != list(range(256)):
        raise ValueError("the first 256 ids must be those of the bytes")
    byte_ids = _literal_array([ranks[bytes([b])] for b in range(256)], "int")
    bits = _literal_array(neighbours(vocab_path))
    # The table stands in the plan once: everything else is within this.
    return _let(_literal_array(pair_table(vocab_path)), lambda table: _encoded(piece, byte_ids, bits, table))


def _encoded(piece: Column, byte_ids: Column, bits: Column, table: Column) -> Column:
    none, mask = F.lit(NO_MERGE).cast("bigint"), (1 << SLOT_BITS) - 1

    def merged(a: Column, b: Column) -> Column:
        """The id that a pair merges to; NO_MERGE or more where it does not merge: a matching entry leaves just its id."""
        pair = F.shiftleft(a.cast("bigint"), ID_BITS).bitwiseOR(b.cast("bigint"))
        probes = (F.get(table, (F.shiftright(pair * F.lit(m), s).bitwiseAND(F.lit(mask)) + F.lit(i * (mask + 1))).cast("int")) for i, (m, s) in enumerate(zip(MULTIPLIERS, SHIFTS, strict=True)))
        return F.least(*(p.bitwiseXOR(F.shiftleft(pair, ID_BITS)) for p in probes))

    def next_of(ids: Column) -> Column:
        return F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1), merged)

    def fold(start: Column) -> Column:
        """The ids of a fragment of at least two bytes."""
        zero = F.struct(start.alias("ids"), next_of(start).alias("next"))
        return F.aggregate(F.sequence(F.lit(2), F.size(start)), zero, step, lambda s: s["ids"])

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["next"]), lambda low: F.when(F.coalesce(low, none) >= none, state).otherwise(_let(F.array_position(state["next"], low).cast("int"), lambda at: merge_at(state["ids"], state["next"], low, at))))

    def merge_at(ids: Column, nxt: Column, low: Column, at: Column) -> Column:
        """The pair at `at` becomes the id `low`; only the pairs beside it are looked up again."""
        new = low.cast("int")
        left = F.when(at > 1, F.array(merged(F.get(ids, at - 2), new))).otherwise(F.array().cast("array<bigint>"))
        right = F.when(at < F.size(nxt), F.array(merged(new, F.get(ids, at + 1)))).otherwise(F.array().cast("array<bigint>"))
        new_ids = F.concat(F.slice(ids, 1, at - 1), F.array(new), F.slice(ids, at + 2, F.size(ids)))
        new_next = F.concat(F.slice(nxt, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(nxt, at + 2, F.size(nxt)))
        return F.struct(new_ids.alias("ids"), new_next.alias("next"))

    def rounds(start: Column) -> Column:
        """The same for long fragments: each round merges all places of the lowest pair, from the left, in a list written as text."""

        def merge_all(ids: Column, low: Column, at: Column) -> Column:
            sign = lambda x: F.concat(F.lit(","), x.cast("string"), F.lit(","))
            pair = F.concat(sign(F.get(ids, at - 1)), sign(F.get(ids, at)))
            text = F.replace(F.array_join(F.transform(ids, sign), ""), pair, sign(low))
            return F.split(F.trim(text, F.lit(",")), ",,").cast("array<int>")

        def one(ids: Column, _: Column) -> Column:
            after = _let(next_of(ids), lambda nxt: _let(F.array_min(nxt), lambda low: F.when(F.coalesce(low, none) >= none, F.array().cast("array<int>")).otherwise(merge_all(ids, low, F.array_position(nxt, low).cast("int")))))
            return F.when(F.get(ids, F.lit(-1) + F.size(ids)) < 0, ids).otherwise(_let(after, lambda new: F.when(F.size(new) == 0, F.concat(ids, F.array(F.lit(-1)))).otherwise(new)))

        # A finished list is marked by -1 at its end, so that it isn't searched again.
        return F.aggregate(F.sequence(F.lit(1), F.size(start)), start, one, lambda ids: F.filter(ids, lambda i: i >= 0))

    def beside(a: Column, b: Column) -> Column:
        at = F.shiftleft(a, 8).bitwiseOR(b)
        return F.call_function("shiftright", F.get(bits, F.shiftright(at, 5)), at.bitwiseAND(F.lit(31))).bitwiseAND(F.lit(1))

    def fragments(start: Column) -> Column:
        """The byte ids of a piece, cut where no token holds both neighbours."""
        inner = F.transform(F.sequence(F.lit(1), F.size(start) - 1), lambda k: F.when(beside(F.get(start, k - 1), F.get(start, k)) == 0, k))
        cuts = F.concat(F.array(F.lit(0)), F.array_compact(inner), F.array(F.size(start)))
        return _let(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.slice(start, F.get(c, k - 1) + 1, F.get(c, k) - F.get(c, k - 1))))

    latin = F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1")
    start = F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), lambda c: F.element_at(byte_ids, F.ascii(c) + 1))
    encode = lambda f: F.when(F.size(f) < 2, f).when(F.size(f) <= LONG, fold(f)).otherwise(rounds(f))
    return _let(start, lambda ids: F.when(F.size(ids) < 2, ids).otherwise(F.flatten(F.transform(fragments(ids), encode))))


def _let(value: Column, use) -> Column:
    """use(value) with the value evaluated once: Spark evaluates an expression anew at each place in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """(id_col, ids): one row for each distinct id of docs.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary
    text. Of an id with several texts the one with the smallest hash counts, so repeated rows count
    once; null comes before any text. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(-(2**63))).alias("_h")), "_id")
    pieces = rows.select("_id", F.when(F.col("_text") == "", F.lit(-(2**63))).otherwise(F.col("_h")).alias("_h"), F.regexp_extract_all(F.col("_text"), F.lit(PIECES), F.lit(0)).alias("_pieces"))
    coded = pieces.select("_id", "_h", "_pieces", whole_tokens(F.col("_pieces"), vocab_path).alias("_codes"))
    # Places (from 1) of the pieces that are no tokens; what stands between them is ids already.
    placed = coded.withColumn("_at", F.array_compact(F.transform("_codes", lambda c, i: F.when(c < 0, i + 1))))
    # Written as a table in the shared folder: it is read for the words, for their places and for the result.
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    placed.select("_id", "_h", "_codes", "_at", F.transform("_at", lambda k: F.get("_pieces", k - 1)).alias("_rest")).write.parquet(folder)
    held = spark.read.parquet(folder)
    rest = held.select("_id", "_h", F.explode(F.arrays_zip("_at", "_rest")).alias("r")).select("_id", "_h", F.col("r._at").alias("_place"), F.col("r._rest").alias("_piece"))
    # Few bytes but much work for each word: a fixed number of partitions, which the planner doesn't merge.
    n = parallelism(spark)
    words = rest.groupBy("_piece").agg(F.count("*").alias("_n")).repartition(n, "_piece")
    words = cut_lineage(words.select("_piece", "_n", encode_piece(F.col("_piece"), vocab_path).alias("_ids")))
    # At most 4 * n words can be so frequent that their rows would fill a task: these are broadcast, the others joined.
    total = words.agg(F.sum("_n")).first()[0] or 0
    frequent = F.col("_n") * (4 * n) > total
    often, seldom = words.where(frequent).drop("_n"), words.where(~frequent).drop("_n")
    found = rest.join(F.broadcast(often), "_piece", "left")  # at most 4 * n rows
    key = ("_id", "_h", "_place", "_ids")
    matched = found.where("_ids is not null").select(*key).unionByName(found.where("_ids is null").drop("_ids").join(seldom, "_piece").select(*key))
    parts = matched.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("_place", "_ids"))).alias("_parts"))
    once = held.groupBy("_id").agg(F.min_by(F.struct("_h", "_codes", "_at"), "_h").alias("r")).select("_id", "r.*")
    edges = F.concat(F.array(F.lit(0)), F.col("_at"), F.array(F.size("_codes") + 1))
    runs = F.transform(F.sequence(F.lit(1), F.size("_at") + 1), lambda k: F.slice("_codes", F.get("_edges", k - 1) + 1, F.get("_edges", k) - F.get("_edges", k - 1) - 1))
    between = F.zip_with(runs, F.coalesce(F.col("_parts._ids"), F.array().cast("array<array<int>>")), lambda run, ids: F.concat(run, F.coalesce(ids, F.array().cast("array<int>"))))
    out = once.join(parts, ["_id", "_h"], "left").withColumn("_edges", edges)
    return out.select(F.col("_id").alias(id_col), F.when(F.size("_at") == 0, F.col("_codes")).otherwise(F.flatten(between)).alias("ids"))


def decode_ids(ids: Column, vocab_path: str = DEFAULT_VOCAB) -> Column:
    """The text of a list of ids: the tokens' bytes, concatenated and read as UTF-8."""
    ranks = load_ranks(vocab_path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    hexes = F.split(F.lit(",".join(t.hex() for t in by_id)), ",")
    return F.decode(F.aggregate(ids, F.unhex(F.lit("")), lambda acc, i: F.concat(acc, F.unhex(F.element_at(hexes, i + 1)))), "UTF-8")
