"""Byte-level BPE of a public tokenizer in Spark's own higher-order functions.

Words are cut out by the tokenizer's pattern. A word that is a vocabulary entry is one id;
every other distinct word is folded once over the array of its bytes' ids: each step merges
the adjacent pair of least rank, until no pair has one. The rank of a pair, which is also the
id of the merged piece, comes from a literal map laid out so that a look-up is two array
reads. Decoding concatenates the binary pieces.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the literal map of whole words.
CELLS = 1 << 16
#: Words of more bytes are folded by merging every occurrence of the best pair at once.
LONG = 48
#: Words of a text among which equal ones are folded once; bounds each look-up among them.
CHUNK = 512
#: The rank of a pair that is never merged, and the id beside the first and the last piece.
NEVER = 0xFFFF
# Fixed value: the pattern that cuts text into words, in Java's syntax, without needless backtracking.
WORDS = r"'(?:[stmd]|re|ve|ll)| ?+\p{L}++| ?+\p{N}++| ?+[^\p{IsWhite_Space}\p{L}\p{N}]++|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def vocabulary_path() -> str:
    """Place of the rank file, unless the caller names another."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[str, int]:
    """Rank of each piece; a piece is written with one character (0 to 255) for a byte."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}


def merges(of: dict[str, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, rank) of each piece of two bytes or more: what is left of its bytes
    when all merges of lower rank are done. The id of a piece is its rank."""
    out = []
    for piece, rank in of.items():
        parts = list(piece)
        while len(parts) > 2:
            known = [(r, i) for i in range(len(parts) - 1) if (r := of.get(parts[i] + parts[i + 1], rank)) < rank]
            if not known:
                break
            at = min(known)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((of[parts[0]], of[parts[1]], rank))
    return out


@lru_cache(maxsize=2)
def _pair_table(path: str) -> str:
    """The ranks of all pairs as one array: row ``left`` begins at ``at[left]``, and the rank
    of (left, right) stands ``right`` places on, beside ``left + 1``. Rows interlock: the wide
    ones take the first place where their entries meet empty cells, single entries fill up."""
    rows: dict[int, dict[int, int]] = {}
    for left, right, rank in merges(ranks(path)):
        rows.setdefault(left, {})[right] = rank
    used, free, begin = np.zeros(1 << 20, dtype=bool), NEVER, [1 << 24] * (NEVER + 1)
    cells: dict[int, int] = {}
    for left, row in sorted(rows.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        at = np.array(sorted(row))
        while used[free]:
            free += 1
        move = free - int(at[0])
        while len(at) > 1:
            fits = ~used[(move + np.arange(256))[:, None] + at].any(axis=1)
            if fits.any():
                move += int(fits.argmax())
                break
            move += 256
            free = max(free, move + int(at[0]) - 4096)
        begin[left] = move
        used[at + move] = True
        cells |= {right + move: left + 1 << 16 | rank for right, rank in row.items()}
    low, high = min(cells), max(cells)
    byte = [ranks(path)[chr(i)] for i in range(256)]
    pair = {(left, right): rank for left, row in rows.items() for right, rank in row.items()}
    return json.dumps({
        "at": [min(b, high + 1) - low for b in begin],
        "cells": [cells.get(i, 0) for i in range(low, high + NEVER + 2)],
        # The numbers of the folding's first state, by two bytes, and by the last byte.
        "first": [pair.get((a, b), NEVER) << 16 | a for a in byte for b in byte],
        "last": [NEVER << 16 | a for a in byte],
    }, separators=(",", ":"))


def _pairs(path: str) -> Column:
    return F.from_json(F.lit(_pair_table(path)), "at array<int>, cells array<bigint>, first array<bigint>, last array<bigint>")


def spark_hash(data: bytes) -> int:
    """What Spark's ``hash`` gives for one string: 32-bit Murmur3 with seed 42, the bytes
    behind the last whole word mixed one by one."""
    def mixed(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        return ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = 42, len(data) & ~3
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mixed(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _whole(path: str, known: dict[str, list[int]] | None = None) -> Column:
    """Literal map from a word to its ids: vocabulary entries that are text, and words folded before."""
    cells: list[dict[str, list[int]]] = [{} for _ in range(CELLS)]
    entries: dict[str, list[int]] = {}
    for piece, rank in ranks(path).items():
        try:
            entries[piece.encode("latin-1").decode()] = [rank]
        except UnicodeDecodeError:
            continue  # a part of a character is no word
    for word, ids in (entries | (known or {})).items():
        cells[spark_hash(word.encode()) % CELLS][word] = ids
    return F.from_json(F.lit(json.dumps(cells, separators=(",", ":"))), "array<map<string,array<int>>>")


def _ids_of(whole: Column, word: Column) -> Column:
    return F.get(whole, F.hash(word).bitwiseAND(CELLS - 1))[word]


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _own(number: Column) -> Column:
    return number.bitwiseAND(NEVER)


def _numbered(pairs: Column, left: Column, right: Column) -> Column:
    """A number for a piece beside its neighbour: the rank of the pair, then the piece's id.

    The cell of another row, or of none, differs in its upper bits, and so counts as never.
    """
    cell = pairs["cells"][pairs["at"][left] + right]
    return F.shiftleft(F.least(cell.bitwiseXOR(F.shiftleft(left + 1, 16)), F.lit(NEVER).cast("long")), 16).bitwiseOR(left)


def _fold(pairs: Column, word: Column) -> Column:
    """Ids of a word (one character a byte), merging the leftmost pair of least rank in each step.

    The state has the number of each piece. So the least number tells the pair and the id it
    becomes, and a merge changes the two numbers that name it. The state begins and ends with
    a neighbour that is no piece.
    """
    none = F.lit(NEVER << 16 | NEVER).cast("long")

    def start(codes: Column) -> Column:
        inner = F.transform(codes, lambda c, i: F.coalesce(pairs["first"][c * 256 + F.get(codes, i + 1)], pairs["last"][c]))
        return F.concat(F.array(none), inner, F.array(none))

    def step(state: Column, _: Column) -> Column:
        def merged(k: Column) -> Column:
            new = F.shiftright(F.get(state, k - 1), 16)

            def moved(number: Column, i: Column) -> Column:
                own = F.when(i == k, F.lit(None).cast("long")).when(i == k - 1, _numbered(pairs, new, _own(F.get(state, k + 1))))
                return own.when(i == k - 2, _numbered(pairs, _own(number), new)).otherwise(number)

            return F.filter(F.transform(state, moved), lambda number: number.isNotNull())

        least = F.array_min(state)
        return F.when(least >= NEVER << 16, state).otherwise(_let(F.array_position(state, least).cast("int"), merged))

    codes = F.transform(F.split(word, ""), F.ascii)
    return F.aggregate(F.sequence(F.lit(2), F.length(word)), _let(codes, start), step, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda e: _own(e).cast("int")))


def _fold_long(pairs: Column, word: Column) -> Column:
    """The same for a long word: the ids as text in brackets, a pair is merged wherever it occurs."""
    inner = lambda s: F.transform(F.split(F.btrim(s, F.lit("[]")), "\\]\\["), lambda x: x.cast("long"))
    bracketed = lambda *ids: F.concat(F.lit("["), F.concat_ws("][", *ids), F.lit("]"))
    codes = F.transform(F.split(word, ""), lambda c: _own(pairs["last"][F.ascii(c)]).cast("string"))
    start = F.struct(bracketed(codes).alias("s"), F.lit(True).alias("go"))

    def step(acc: Column, _: Column) -> Column:
        def merged(ids: Column) -> Column:
            numbers = F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: _numbered(pairs, a, b))

            def at(numbers: Column) -> Column:
                least = F.array_min(numbers)
                k = F.array_position(numbers, least).cast("int")
                pair = bracketed(F.get(ids, k - 1).cast("string"), F.get(ids, k).cast("string"))
                new = F.replace(acc["s"], pair, bracketed(F.shiftright(least, 16).cast("string")))
                go = F.coalesce(least < NEVER << 16, F.lit(False))
                return F.struct(F.when(go, new).otherwise(acc["s"]).alias("s"), go.alias("go"))

            return _let(numbers, at)

        return F.when(acc["go"], _let(inner(acc["s"]), merged)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda acc: F.transform(inner(acc["s"]), lambda x: x.cast("int")))


def _bytes(word: Column) -> Column:
    """The word's bytes, one character each; the word itself where all of it is ASCII."""
    return F.when(F.length(word) == F.octet_length(word), word).otherwise(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"))


def _folded(pairs: Column, word: Column) -> Column:
    return _let(_bytes(word), lambda w: F.when(F.length(w) <= LONG, _fold(pairs, w)).otherwise(_fold_long(pairs, w)))


def token_ids(text: Column, path: str | None = None, known: dict[str, list[int]] | None = None) -> Column:
    """Token ids of a text, without special tokens; an empty array for a null or empty text.

    Strings that look like control tokens are ordinary text. Each word's result depends on
    the word alone, so nothing is shuffled and no key can be hot; equal words of one chunk of
    a text are folded once. ``known`` holds ids of words folded before (see
    :func:`frequent_words`); it saves time and changes no result.
    """
    place = path or vocabulary_path()
    tables = F.struct(_pairs(place).alias("pairs"), _whole(place, known).alias("whole"))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def with_tables(t: Column) -> Column:
        def of_chunk(ws: Column) -> Column:
            def ids(seen: Column) -> Column:
                open_ = F.array_distinct(F.filter(ws, lambda w, i: F.get(seen, i).isNull()))
                folded = _let(open_, lambda u: F.map_from_arrays(u, F.transform(u, lambda w: _folded(t["pairs"], w))))
                return _let(folded, lambda own: F.flatten(F.zip_with(ws, seen, lambda w, k: F.coalesce(k, own[w]))))

            return _let(F.transform(ws, lambda w: _ids_of(t["whole"], w)), ids)

        def of_text(ws: Column) -> Column:
            first = F.sequence(F.lit(1), F.size(ws), F.lit(CHUNK))
            return F.when(F.size(ws) > 0, F.flatten(F.transform(first, lambda i: _let(F.slice(ws, i, F.lit(CHUNK)), of_chunk))))

        return _let(words, of_text)

    return F.coalesce(_let(tables, with_tables), F.array().cast("array<int>"))


def frequent_words(documents: DataFrame, path: str | None = None, text: str = "text", sample: int = 6000, most: int = 20_000, seed: int = 42) -> dict[str, list[int]]:
    """Ids of words that recur in a seeded draw of about ``sample`` documents and are no
    vocabulary entries.

    At most ``most`` words; each distinct word is folded once. Only time depends on the draw.
    """
    place = path or vocabulary_path()
    drawn = documents.select(text).sample(min(1.0, sample / max(1, documents.count())), seed)
    words = drawn.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORDS), F.lit(0))).alias("w")).groupBy("w").count().where("count > 1")
    open_ = words.where(_let(_whole(place), lambda t: _ids_of(t, F.col("w"))).isNull())
    top = open_.orderBy(F.col("count").desc(), "w").limit(most)
    return {r["w"]: r["ids"] for r in top.select("w", _let(_pairs(place), lambda t: _folded(t, F.col("w"))).alias("ids")).collect()}


def encode(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``documents`` with a column ``ids``: see :func:`token_ids`."""
    return documents.withColumn("ids", token_ids(F.col(text), path, frequent_words(documents, path, text)))


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of token ids: their binary pieces, concatenated. Null ids give null.

    Runs of pieces are concatenated first, as many in a run as there are runs.
    """
    pieces = [base64.b64encode(p.encode("latin-1")).decode() for p, _ in sorted(ranks(path or vocabulary_path()).items(), key=lambda kv: kv[1])]
    table = F.from_json(F.lit(json.dumps(pieces)), "array<binary>")
    joined = lambda xs: F.aggregate(xs, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    run = F.ceil(F.sqrt(F.size(ids))).cast("int")
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(ids), run), lambda i: joined(F.transform(F.slice(ids, i, run), lambda k: F.get(t, k))))
    return F.when(F.size(ids) > 0, F.decode(joined(_let(table, runs)), "UTF-8")).when(ids.isNotNull(), "")
