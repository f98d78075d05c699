"""Texts that were cut off, found by how their last words stand elsewhere in the corpus.

Word trigrams are counted inside texts and at their ends, in SQL. A text whose final trigram
is frequent inside texts but almost never ends one stops within a sentence. If the last word
is cut, too, the trigrams count that begin like the final one: the same two words, and a word
that goes on from the last. An encoded attachment is one word to the trigrams, so a text that
stops within one ends like no whole message does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.operators.common import cut, hot_values, salted_join

#: Least count inside texts for a final trigram to tell anything.
FREQUENT = 3
#: Greatest share of ends among all occurrences of a final trigram that is never terminal.
TERMINAL_SHARE = 0.05
#: The same for the last word alone.
WORD_SHARE = 0.01

# A word is an e-mail address, a run of letters and digits (which count as 0), one
# character of a script without spaces, or a mark that ends a sentence. The first characters of
# these scripts are at U+2E80: below, no script is looked up, which takes a search each.
_WORD = r"[\\p{L}0.+-]++@[\\p{L}0.-]*+|[\\p{L}\\p{M}0&&[\\x00-\\u2E7F[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]]]++|[.!?。…:>-]|[\\u2E80-\\x{10FFFF}&&[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]]"

#: Beginnings of words are met exactly up to so many characters, longer ones by these and as a whole.
BEGIN = 16

# Soft line breaks and escapes of quoted-printable are undone, an escape broken off at the end
# is left out; the body of a base64 part and an encoded word are one word each.
PREPARED = r"""
with raw as (
  select doc_id, source, replace(text, chr(13), '') as t,
    regexp_extract(text, 'boundary="?([^"\\s;]+)', 1) as edge,
    rlike(text, '(?i)transfer-encoding: *quoted-printable') as qp, rlike(text, '(?i)transfer-encoding: *base64') as b64
  from @documents where text is not null and rlike(text, '\\S')),
plain as (
  select doc_id, source, t, edge, qp, b64,
    case when qp then coalesce(try_url_decode(regexp_replace(replace(replace(regexp_replace(t, '=\\n|=[0-9A-F]?$', ''), '%', '%25'), '+', '%2B'), '=([0-9A-F]{2})', '%$1')), t) else t end as u
  from raw),
worded as (
  select doc_id, source, edge <> '' and instr(t, concat('--', edge, '--')) = 0 as unclosed,
    edge <> '' and instr(t, concat('--', edge, '--')) > 0 as closed,
    qp and rlike(t, '=[0-9A-F]?\\s*$') as broken_escape, endswith(t, '\n\n') as parted,
    regexp_extract_all(regexp_replace(case when b64 then regexp_replace(u, '(?i)(transfer-encoding: *base64[^\\n]*+\\n(?:[^\\n]++\\n)*+\\n)[A-Za-z0-9+/=\\n]++', '$1 0 \n') else u end, '(?m)(?:^[A-Za-z0-9+/=]{40,}+$\\n?+)++|=[?][^?\\s]++[?][BbQq][?][^?\\s]*+[?]=|[1-9]', '0'), '@word', 0) as w
  from plain)
select doc_id, source, unclosed, closed, broken_escape, parted, w, size(w) as n from worded
"""

# Trigrams inside texts: the two words before, the word, and how often. They are counted by their
# three words and joined after, as often as there are different ones; no word has a blank.
INSIDE = """
select concat_ws(' ', x, y) as a, z as b, count(*) as n from (
  select g.`0` as x, g.`1` as y, g.`2` as z from (
    select explode(arrays_zip(slice(w, 1, n - 3), slice(w, 2, n - 3), slice(w, 3, n - 3))) as g from @words where n > 3))
group by x, y, z
"""

# The last trigram of each text.
FINAL = """
select doc_id, source, unclosed, closed, broken_escape, parted,
  case when n >= 3 then concat_ws(' ', w[n - 3], w[n - 2]) end as a, case when n >= 3 then w[n - 1] end as b
from @words
"""

# Distinct final trigrams: how often they end a text (n_end), and how often the same words
# (n_same), or words that go on from the last one (n_longer), stand inside. Trigrams are met by
# the beginnings of their last word, so that no pair of words is met with all that follow it.
OF_TRIGRAM = """
with ends as (select a, b, count(*) as n_end from @final where not closed and b is not null group by a, b),
near as (select i.a, i.b, i.n from @inside i left semi join ends e on e.a = i.a),
begun as (select a, start, sum(case when start = b then n end) as n_same, sum(case when start <> b then n end) as n_longer
  from (select a, b, n, explode(transform(sequence(1, least(length(b), @begin)), i -> left(b, i))) as start from near) group by a, start),
lengthy as (select e.a, e.b, sum(case when i.b = e.b then i.n end) as n_same, sum(case when i.b <> e.b and startswith(i.b, e.b) then i.n end) as n_longer
  from (select a, b, left(b, @begin) as start from ends where length(b) > @begin) e join (select a, b, n, left(b, @begin) as start from near where length(b) > @begin) i on i.a = e.a and i.start = e.start group by e.a, e.b)
select e.a, e.b, e.n_end, coalesce(begun.n_same, l.n_same, 0) as n_same, coalesce(begun.n_longer, l.n_longer, 0) as n_longer
from ends e left join begun on begun.a = e.a and begun.start = e.b left join lengthy l on l.a = e.a and l.b = e.b
"""

# The same for the final word alone.
OF_WORD = """
with ends as (select b, count(*) as w_end from @final where not closed and b is not null group by b),
words as (select b, sum(n) as n from @inside group by b),
begun as (select start, sum(case when start = b then n end) as w_same, sum(case when start <> b then n end) as w_longer
  from (select b, n, explode(transform(sequence(1, least(length(b), @begin)), i -> left(b, i))) as start from words) group by start),
lengthy as (select e.b, sum(case when w.b = e.b then w.n end) as w_same, sum(case when w.b <> e.b and startswith(w.b, e.b) then w.n end) as w_longer
  from (select b, left(b, @begin) as start from ends where length(b) > @begin) e join (select b, n, left(b, @begin) as start from words where length(b) > @begin) w on w.start = e.start group by e.b)
select e.b, e.w_end, coalesce(begun.w_same, l.w_same, 0) as w_same, coalesce(begun.w_longer, l.w_longer, 0) as w_longer
from ends e left join begun on begun.start = e.b left join lengthy l on l.b = e.b
"""

# A text is cut if its final trigram, with the last word as it stands or going on, is frequent
# inside texts and almost never at an end, and if its last word, too, ends few texts. A last
# word that never stands inside texts after any two words, but begins frequent ones, is cut.
DECIDED = """
with judged as (select *, n_same + n_longer >= @frequent and n_end - 1 <= @share * (n_same + n_longer) as rare_end,
    not closed and not parted and b is not null and not rlike(b, '^[.!?。…:>-]$') as open, not rlike(b, '^0+$') as worded from @met)
select doc_id, source, a, b, n_end, n_same, n_longer, w_end, w_same, w_longer, unclosed, broken_escape,
  case when open and rare_end and (w_end <= @word_share * w_same or n_same >= 100 and n_end <= @word_share * n_same) then 'sentence'
    when open and rare_end and worded and n_same = 0 and w_end <= greatest(1, @share * (w_same + w_longer)) then 'word'
    when open and worded and w_same = 0 and n_same + n_longer < @frequent and w_longer >= @frequent and w_end <= @share * w_longer then 'unseen' end as how
from judged
"""


def _sql(query: str, **tables: DataFrame) -> DataFrame:
    """The query over the given tables; their views are dropped once it is analysed."""
    spark = next(iter(tables.values())).sparkSession
    views = {name: f"_trussline_{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
        query = query.replace(f"@{name}", view)
    try:
        return spark.sql(query)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def truncated(documents: DataFrame, frequent: int = FREQUENT, share: float = TERMINAL_SHARE) -> DataFrame:
    """doc_id, source, the final trigram with its counts, ``how`` and ``is_cut``, for every text.

    ``how`` names what shows the cut: ``sentence`` (the final trigram), ``word`` (the final
    trigram with its last word going on) or ``unseen`` (a last word that only begins others,
    after two words that tell too little). ``unclosed`` (an outer MIME boundary that never
    closes) and ``broken_escape`` are told beside it and decide nothing.

    Null, empty and blank texts have no row. A text of fewer than three words has no final
    trigram and so is never cut. Counts run over all texts. A hot final trigram (a footer that
    a third of all texts end with) is counted before any join, and its texts are salted.
    """
    words = cut(_sql(PREPARED.replace("@word", _WORD), documents=documents))
    inside = cut(_sql(INSIDE, words=words))
    final = cut(_sql(FINAL, words=words))
    tri, word = (_sql(q.replace("@begin", str(BEGIN)), final=final, inside=inside) for q in (OF_TRIGRAM, OF_WORD))
    hot = hot_values(final, ["b"])["b"]
    often = F.col("b").isin(hot) if hot else F.lit(False)
    met = salted_join(salted_join(final, tri, ["a", "b"], often, F.col("doc_id")), word, ["b"], often, F.col("doc_id"))
    told = _sql(DECIDED.replace("@frequent", str(frequent)).replace("@share", str(share)).replace("@word_share", str(WORD_SHARE)), met=met)
    return told.withColumn("is_cut", F.col("how").isNotNull())


def truncation_shares(documents: DataFrame) -> DataFrame:
    """Texts, cut texts and their share, per source."""
    return truncated(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.avg(F.coalesce("is_cut", F.lit(False)).cast("double")).alias("share_cut"))
