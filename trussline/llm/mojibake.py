"""Text that was decoded with the wrong character encoding: detection and restoration.

A smoothed character trigram model is trained on the clean names. Every candidate chain
(encode with the wrong encoding, decode with the right one) of a suspect name is scored by
it, and the likeliest is accepted if it beats the name as it stands by a margin that is
validated on all clean names and on each of them damaged on purpose in every known way.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.operators.common import cut, salted_join

#: Buckets of the hashed n-gram table: bounds the model, whatever the corpus.
BUCKETS = 1 << 18
#: Gains among which the margin is chosen.
LEVELS = [m / 2 for m in range(2, 41)]

# Encodings that text is read with by mistake, and that it was written in.
WRONG = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "iso8859_2", "cp1253"]
RIGHT = ["cp1251", "koi8_r", "cp866", "iso8859_5", "iso8859_2", "cp1250", "cp1253", "iso8859_7", "cp932", "euc_jp", "big5", "cp1252", "cp437", "cp850", "mac_roman"]
#: Damage that the margin is validated on: written as the first, read as the second.
DAMAGE = [("utf-8", w) for w in WRONG] + [("cp1251", "cp1252"), ("iso8859_2", "cp1252"), ("cp932", "cp1252"), ("cp1253", "cp1252")]
#: Names without these serve for training: replacement and C1 characters, marks or symbols
#: beside another non-ASCII character, three accented Latin letters in a row, a Latin-1 sign
#: inside a word, and letters of two scripts side by side.
SUSPECT = r"[\x{FFFD}\x{80}-\x{A0}]|(?![’“”–—])[^\x00-\x7F\p{L}][^\x00-\x7F]|[^\x00-\x7F](?![’“”–—])[^\x00-\x7F\p{L}]|[\x{C0}-\x{FF}]{3}|\p{L}[\x{A1}-\x{BF}]\p{L}|[A-Za-z](?![’“”–—º³±ªß])[\x{2000}-\x{2BFF}]|[\p{IsCyrillic}][\p{IsLatin}]|[\p{IsLatin}][\p{IsCyrillic}\p{IsGreek}]|[\x{C0}-\x{DE}][\x{100}-\x{192}]|[\x{100}-\x{192}][\x{C0}-\x{DE}]"


def _tables() -> dict[str, dict[str, int]]:
    """Character to byte of each wrong encoding; undefined bytes stand for themselves."""
    out = {}
    for name in WRONG:
        table = {chr(b): b for b in range(0x80, 0xA0)}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b
        out[name] = table
    return out


TABLES = _tables()
#: The same for str.translate; a lost character is left out.
TO_BYTES = {n: {ord(c): b for c, b in t.items() if c >= "\x80"} | {0xFFFD: None} for n, t in TABLES.items()}


def _start(table: dict[str, int]) -> re.Pattern[str]:
    """What any piece of UTF-8 begins with: a leading byte, and a continuation byte or a place where one was lost."""
    leads, more = ("".join(c for c, b in table.items() if lo <= b <= hi) for lo, hi in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"[{re.escape(leads)}][{re.escape(more)}\ufffd ]")


STARTS = {n: _start(t) for n, t in TABLES.items()}
#: Bytes that an encoding does not define: what a lost character may have been.
LOST = {n: [b for b in range(0x80, 0xC0) if not bytes([b]).decode(n, "ignore")] + [0xA0, 0x98, 0xAD] for n in WRONG}


def utf8_pieces(text: str, wrong: str, fill: int | None = None) -> tuple[str, bool, bool]:
    """``text`` with each piece that is UTF-8 misread as ``wrong`` decoded.

    Also tells whether bytes were made up, and whether a piece lacks one byte. Other
    characters stay, so a name damaged in part is restored in part. ``fill`` stands in for
    one lost continuation byte of a sequence.
    """
    if not STARTS[wrong].search(text):
        return text, False, False
    table = TABLES[wrong]
    out, i, guessed, short = [], 0, False, False
    while i < len(text):
        b = table.get(text[i], 0)
        need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        if need:
            got, j, lost = [b], i + 1, 0
            while len(got) <= need and j < len(text):
                c = table.get(text[j], 0)
                if 0x80 <= c <= 0xBF:
                    got.append(c)
                elif text[j] == "\ufffd" and not lost:
                    got.append(fill or 0)
                    lost = 1
                else:
                    break
                j += 1
            if len(got) == need and not lost and need + (text[j : j + 1] == " ") > 1:
                got.append(fill or 0)
                lost = 1
            if len(got) == need + 1:
                short = short or bool(lost)
                if fill is not None or not lost:
                    try:
                        out.append(bytes(got).decode())
                        i, guessed = j, guessed or bool(lost)
                        continue
                    except UnicodeDecodeError:
                        pass
        out.append(text[i])
        i += 1
    return "".join(out), guessed, short


def whole(data: bytes, right: str) -> tuple[str, int] | None:
    """``data`` decoded as ``right``, and the number of bytes left out."""
    try:
        return data.decode(right), 0
    except UnicodeDecodeError:
        if right not in ("cp932", "euc_jp"):
            return None
        back = data.decode(right, "replace")
        return back.replace("\ufffd", ""), back.count("\ufffd")


def candidates(text: str) -> Iterator[tuple[str, bool, float]]:
    """Every chain's result, whether it is lossy, and its cost; UTF-8 misread twice included."""
    seen = {text}
    wide = {c for c in text if c >= "\x80" and c != "\ufffd"}
    for wrong in WRONG:
        if wrong != "cp1252" and not wide & TABLES[wrong].keys():
            continue
        got = utf8_pieces(text, wrong)
        for fill in (None, *(LOST[wrong] if got[2] else ())):
            one, guessed, _ = got if fill is None else utf8_pieces(text, wrong, fill)
            if one not in seen:
                seen.add(one)
                yield one, guessed, 0.0
                for again in WRONG:
                    twice, more, _ = utf8_pieces(one, again)
                    if twice not in seen:
                        seen.add(twice)
                        yield twice, guessed or more, 1.0
        if wide <= TABLES[wrong].keys():
            data, gone = text.translate(TO_BYTES[wrong]).encode("latin-1"), text.count("\ufffd")
            for right in RIGHT:
                if right != wrong and (back := whole(data, right)) and back[0] not in seen and back[0].isprintable():
                    seen.add(back[0])
                    lost = gone + back[1]
                    yield back[0], lost > 0, 3.0 + 4.0 * lost


def damaged(text: str) -> Iterator[str]:
    """``text`` after each :data:`DAMAGE` that applies to it and changes it."""
    for wrote, read in DAMAGE:
        try:
            hurt = text.encode(wrote).decode(read, "replace")
        except UnicodeEncodeError:
            continue
        if hurt != text:
            yield hurt


class Model:
    """Interpolated character trigram model over a hashed count table of fixed size."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = counts
        self.total = max(1, counts.get(-1, 0))
        self.known: dict[str, float] = {}

    def _n(self, gram: str) -> int:
        return self.counts.get(zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS, 0)

    def score(self, text: str) -> float:
        """Log probability of ``text``."""
        padded, total = f"\x02\x02{text}\x03", 0.0
        for i in range(2, len(padded)):
            gram = padded[i - 2 : i + 1]
            p = self.known.get(gram)
            if p is None:
                n3, n2, n12, n1, n0 = self._n(gram), self._n(gram[1:]), self._n(gram[:2]), self._n(gram[1]), self._n(gram[2])
                p = math.log(0.7 * (n3 / n12 if n12 else 0) + 0.25 * (n2 / n1 if n1 else 0) + 0.05 * (n0 + 0.02) / (self.total + 2000))
                if len(self.known) < 500_000:
                    self.known[gram] = p
            total += p
        return total

    def best(self, text: str, enough: float = math.inf) -> tuple[float, str | None, bool]:
        """Gain of the likeliest chain over the text as it stands, its result, whether lossy.

        The first chain that gains more than ``enough`` will do, where only that is asked.
        """
        base, top = self.score(text), (-math.inf, None, False)
        for cand, lossy, cost in candidates(text):
            gain = self.score(cand) - base - cost - lossy
            if gain > top[0]:
                top = (gain, cand, lossy)
                if gain > enough:
                    break
        return top


def masked(column: str) -> Column:
    """The name with every ASCII digit as 0: digits are the same in all these encodings."""
    return F.regexp_replace(F.col(column), "[0-9]", "0")


def shapes_of(names: DataFrame) -> DataFrame:
    """(shape, n): the distinct masked names and how often each occurs, nulls left out."""
    return names.where(F.col("name").isNotNull()).groupBy(masked("name").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def train(clean: DataFrame) -> Model:
    """Model of clean shapes (see :func:`shapes_of`), each weighted with its number.

    Their n-grams are summed into a hashed table of :data:`BUCKETS` rows, all that ever comes
    to the driver.
    """
    padded = F.concat(F.lit("\x02\x02"), F.col("shape"), F.lit("\x03"))
    at = F.sequence(F.lit(1), F.length(padded))
    gram = lambda k: F.transform(at, lambda i: padded.substr(i, F.lit(k)))
    grams = clean.select("n", F.explode(F.concat(gram(1), F.filter(gram(2), lambda g: F.length(g) == 2), F.filter(gram(3), lambda g: F.length(g) == 3))).alias("g"))
    table = grams.groupBy((F.crc32(F.encode("g", "UTF-8")) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.sum(F.when(F.length("g") == 1, F.col("n")).otherwise(0)).alias("one"))
    rows = table.collect()
    counts = {r["b"]: r["n"] for r in rows}
    counts[-1] = sum(r["one"] for r in rows)
    return Model(counts)


def validated_margin(told: DataFrame) -> float:
    """Least gain at which clean names and names damaged on purpose are told apart best.

    ``told``: rows of :data:`SCORED`. All clean shapes and all their damages are counted, by level;
    one row of counts for each of the two comes to the driver.
    """
    over = lambda gains: gains.agg(F.count(F.lit(1)), *[F.count_if(F.col("gain") > m) for m in LEVELS]).first()
    clean = told.where("clean")
    n_good, *good = over(clean)
    n_bad, *bad = over(clean.select(F.explode("hurt").alias("gain")))
    if not n_good or not n_bad:
        return 6.0
    errors = [5 * g / n_good + (n_bad - b) / n_bad for g, b in zip(good, bad, strict=True)]
    best = [m for m, e in zip(LEVELS, errors, strict=True) if e <= min(errors) + 1e-9]
    return best[len(best) // 4]


SCORED = "shape string, n long, clean boolean, back string, gain double, lost boolean, hurt array<double>"


def _gains(shapes: DataFrame, model: Model) -> DataFrame:
    """Rows of :data:`SCORED` for shapes (shape, n, clean) with a character beyond ASCII.

    ``hurt`` holds the gains of a clean shape's damages, exact up to the highest of :data:`LEVELS`.
    """
    sent = shapes.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(sent.value)
        for pdf in batches:
            best = [own.best(x) for x in pdf["shape"]]
            yield pd.DataFrame({
                "shape": pdf["shape"], "n": pdf["n"], "clean": pdf["clean"], "back": [None if lossy else back for _, back, lossy in best], "gain": [gain if gain > -math.inf else None for gain, _, _ in best],
                "lost": [any(c == "\ufffd" or "\x80" <= c < "\xa0" for c in x) for x in pdf["shape"]],
                "hurt": [[own.best(h, LEVELS[-1])[0] for h in damaged(x)] if clean else [] for x, clean in zip(pdf["shape"], pdf["clean"], strict=True)],
            })

    # A number of its own, since few bytes make much work here and would be put into one task.
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shapes.select("shape", "n", "clean").repartition(tasks, "shape").mapInPandas(run, SCORED)


def scored(shapes: DataFrame) -> tuple[DataFrame, float]:
    """Every shape with a character beyond ASCII, scored, and the validated margin.

    ``gain`` of the likeliest chain and its result ``back`` (null if bytes were lost on the
    way, or no chain applies); ``lost`` if the shape holds a replacement or C1 control character.
    Shapes that pass for clean but gain by a chain under a first model are left out of the
    training of the second, which counts: some damage leaves no suspect character behind.
    The others are ``clean``, and the margin is validated on every one of them.
    """
    wide, plain = F.col("shape").rlike(r"[^\x00-\x7F]"), ~F.col("shape").rlike(SUSPECT)
    not_clean = shapes.select("*", F.lit(False).alias("clean"))
    first = cut(_gains(not_clean.where(wide & plain), train(shapes.where(plain))))
    passing = first.select("shape", "n", F.coalesce(F.col("gain") <= 0, F.lit(True)).alias("clean"))
    model = train(passing.where("clean").select("shape", "n").unionByName(shapes.where(~wide)))
    told = cut(_gains(passing.unionByName(not_clean.where(wide & ~plain)), model))
    return told, validated_margin(told)


def with_digits(shape: Column, name: Column) -> Column:
    """``shape`` with its zeros replaced by the digits of ``name``, in order; null if they differ in number."""
    parts, digits = F.split(shape, "0"), F.regexp_extract_all(name, F.lit("[0-9]"), F.lit(0))
    whole = F.array_join(F.zip_with(parts, digits, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    return F.when(F.size(parts) == F.size(digits) + 1, whole)


def garbled(names: DataFrame) -> DataFrame:
    """Damaged names: tab, rec_id, name, restored (null if it can't be had whole), gain, and
    ``by_model``, whether the gain alone tells.

    ``names``: tab, rec_id, name. A name is damaged if a chain makes it likelier by more than
    the validated margin. One that holds a replacement or C1 control character, which no
    encoding writes on purpose, is damaged even if nothing can be gained; ``by_model`` is then
    false. Null, empty and all-ASCII names are never damaged. Repeated rows come out as often
    as they occur. Names that differ in digits only are scored once.
    """
    shapes = cut(shapes_of(names))
    told, margin = scored(shapes)
    bad = told.where((F.col("gain") > margin) | F.col("lost")).select("shape", "n", "back", "gain", F.coalesce(F.col("gain") > margin, F.lit(False)).alias("by_model"))
    often = [r["shape"] for r in bad.where(F.col("n") >= 0.02 * max(1, told.agg(F.sum("n")).first()[0] or 0)).select("shape").collect()]  # 50 at most
    wide = names.where(F.col("name").rlike(r"[^\x00-\x7F]")).select("tab", "rec_id", "name", masked("name").alias("shape"))
    met = salted_join(wide, bad.drop("n"), ["shape"], F.col("shape").isin(often) if often else F.lit(False), F.struct("tab", "rec_id"), "inner")
    return met.select("tab", "rec_id", "name", F.when(F.col("by_model"), with_digits(F.col("back"), F.col("name"))).alias("restored"), "gain", "by_model")
