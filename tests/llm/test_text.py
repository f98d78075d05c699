import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trussline.llm import bpe, mixing, mojibake, truncation

DOC = "doc_id long, text string, source string, tokens string"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source, "clash") for i, t in enumerate(texts)], DOC)


def test_ids_equal_the_public_tokenizer_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = [None, "", " ", "\r\n\t ", "it's I'll 'S", "<|endoftext|> [INST]", "Ünïcödé 検査配管 ⁿ½ 　\u0085x", "👍🏽 ​", "a" * 300, "-" * 217, "=" * 1000, "x" * 5000, "ab" * 400]
    texts += ["".join(rng.choice("abcXYZ019 +/=\n'éж検") for _ in range(rng.randint(1, 200))) for _ in range(150)] + texts[5:8]
    got = bpe.encode(docs(spark, texts)).withColumn("back", bpe.decoded(F.col("ids"))).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert r.ids == t.encode(text or "", add_special_tokens=False).ids, text
        assert r.back == (text or "")
    assert bpe.encode(docs(spark, [])).count() == 0


def test_apportionment_is_sainte_lague_with_caps():
    assert mixing.apportion({"a": 53.0, "b": 24.0, "c": 23.0}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert mixing.apportion({"a": 0.9, "b": 0.1}, 10, {"a": 2, "b": 99}) == {"a": 2, "b": 8}
    assert mixing.apportion({}, 5, {}) == {}


def test_mixture_reaches_shares_within_repeats(spark):
    rng = random.Random(3)
    sizes = spark.createDataFrame([(i, s, rng.randint(1, 50)) for i, s in enumerate(["big"] * 3000 + ["small"] * 200 + ["other"] * 50)] + [(9999, "big", 0), (9998, None, 5)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), (" small ", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(sizes, targets)
    told = {r.source: r for r in report.collect()}
    assert set(told) == {"big", "small", "absent", "other"}
    assert told["small"].actual_share == pytest.approx(1 / 3, abs=0.005) and told["big"].actual_share == pytest.approx(2 / 3, abs=0.005)
    assert told["small"].most_copies <= 3 and told["big"].most_copies == 1 and told["absent"].mix_tokens == 0
    rows = mix.collect()
    assert all(r.tokens > 0 and r.copies >= 1 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, mixing.mixture(sizes, targets)[0].collect())) == sorted(map(tuple, rows))
    assert mixing.mixture(sizes.limit(0), targets)[0].count() == 0


def test_mixture_holds_with_very_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    monkeypatch.setattr(mixing, "SHARDS", 12_000)
    monkeypatch.setattr(mixing, "LEAST_RECORDS", 1)
    rng = random.Random(4)
    of = {"big": (70_000, 0.5, 1), "mid": (30_000, 0.3, 2), "small": (3_000, 0.2, 9)}
    rows = [(i, s, rng.randint(20, 60)) for i, s in enumerate(s for s, (n, _, _) in of.items() for _ in range(n))]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").cache()
    targets = spark.createDataFrame([(s, w, r) for s, (_, w, r) in of.items()], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(sizes, targets)
    told = {r.source: r for r in report.collect()}
    for s, (_, w, most) in of.items():
        assert told[s].actual_share == pytest.approx(w, abs=0.005) and told[s].most_copies <= most
    # The scarcest source is used up to its cap: nothing is lost to the shards' remainders.
    size = sum(r.mix_tokens for r in told.values())
    assert size >= 0.995 * min(told[s].supply_tokens * r / w for s, (_, w, r) in of.items())


def test_mixture_of_a_small_part_keeps_its_shares(spark):
    rng = random.Random(6)
    rows = [(i, "abc"[i % 3], rng.randint(1, 50)) for i in range(60_000)]
    sizes = spark.createDataFrame([*rows, (-1, "d", None)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("c", 0.2, 1), ("d", 0.4, 1), ("e", None, 3), ("f", float("nan"), None), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    told = {r.source: r for r in mixing.mixture(sizes, targets, total=50_000)[1].collect()}
    assert set(told) == set("abcdef")
    assert [told[s].actual_share for s in "abc"] == pytest.approx([0.5, 0.3, 0.2], abs=0.005)
    assert sum(r.mix_tokens for r in told.values()) == pytest.approx(50_000, rel=0.01)


def test_shares_are_those_of_the_mixture(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    sizes = spark.createDataFrame([(i, rng.choice(["p", " q", "r\t", "", None]), rng.randint(0, 90)) for i in range(5000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("p", 0.2, 1), ("q", 0.5, 4), ("q", 0.1, 9), ("z", 0.3, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mixture(sizes, targets)
    db = duckdb.connect()
    for name, df in (("mix", mix), ("sizes", sizes), ("report", report)):
        db.register(name, df.toPandas())
    off = db.sql("""
      with m as (select source, sum(tokens * copies) as t, sum(copies) as n, max(copies) as most from mix group by 1),
      h as (select trim(source, ' ' || chr(9)) as source, count(*) as n, sum(tokens) as t from sizes group by 1)
      select r.source from report r left join m using (source) left join h using (source)
      where r.mix_tokens <> coalesce(m.t, 0) or r.mix_records <> coalesce(m.n, 0) or r.n_records <> coalesce(h.n, 0) or r.supply_tokens <> coalesce(h.t, 0)
        or abs(r.actual_share - coalesce(m.t, 0) / (select sum(t) from m)) > 1e-12 or coalesce(m.most, 0) > r.max_repeats""").fetchall()
    assert off == [] and {r.source: r.max_repeats for r in report.collect()} == {"p": 1, "q": 4, "r": 0, "z": 2}


def test_token_counts_of_null_and_empty(spark):
    pytest.importorskip("tiktoken")
    assert [r.tokens for r in mixing.token_counts(docs(spark, [None, "", "hello world"])).orderBy("doc_id").collect()] == [0, 0, 2]


CLEAN = ["Übergabe der Türanlage {}", "Réception du plancher, côté château {}", "Montaż rurociągu oś {}", "Сварка трубопровода отметка {}", "Fundação do galpão {}", "Inspect duct bank ±{} mm", "Install pump skid “hold point” {}", "検査配管北側 {}"]


def names(spark, rows):
    return spark.createDataFrame([("task", str(i), n, "clash") for i, n in enumerate(rows)], "tab string, rec_id string, name string, restored string")


def test_damaged_names_are_found_and_restored(spark):
    clean = [c.format(i) for i in range(60) for c in CLEAN]
    hurt = {}
    for c in CLEAN[:6]:
        x = c.format(7)
        for wrong in ("cp1252", "cp437", "mac_roman", "cp1251"):
            hurt["".join(mojibake_read(x.encode(), wrong))] = x
    hurt["Ñâàðêà òðóáîïðîâîäà îòìåòêà 7"] = CLEAN[3].format(7)
    hurt["R�ception du plancher, côté château 3"] = None
    rows = clean + [*hurt] + [None, "", "plain ascii", "plain ascii"]
    got = {r.name: r.restored for r in mojibake.garbled(names(spark, rows)).collect()}
    assert got.keys() == hurt.keys()
    assert sum(got[k] == v for k, v in hurt.items() if v) >= 0.9 * (len(hurt) - 1)


def mojibake_read(data, wrong):
    for b in data:
        try:
            yield bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            yield chr(b)


def test_no_names(spark):
    assert mojibake.garbled(names(spark, [])).count() == 0
    assert mojibake.garbled(names(spark, [None, "", "x"])).count() == 0


def test_cut_texts_are_found(spark):
    rng = random.Random(5)
    subj, verb, obj = ["The insurer", "Our planner", "The foreman"], ["keeps asking for", "refuses to pay for", "has to approve"], ["the corrected schedule", "the second permit", "the temporary scaffold"]
    sent = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)} because the gate was locked."
    whole = [" ".join(sent() for _ in range(4)) + f"\n\nRegards\n{rng.choice(['Tavo', 'Nomi', 'Ansk'])}" for _ in range(300)]
    cuts = [w[: w.index("gate") + 2] for w in whole[:5]] + [w[: w.index(" for ") + 4] for w in whole[5:10] if " for " in w]
    part = 'Content-Type: multipart/mixed; boundary="=_x"\n\n--=_x\n\nhi there you\n--=_x\nContent-Transfer-Encoding: base64\n\n'
    mime = [part + "QUJD" * 19 + "\nQUJ", part + "QUJD" * 19 + "\nQUI=\n--=_x--\n"]
    sent_whole = [f"{part}{'QUJD' * 19}\nQ{i}I=\n--=_x--\n" for i in range(150)]
    texts = [*whole, *cuts, *mime, None, "", " \n", "ok", "The forem", "x" * 200_000, whole[0], cuts[0], *sent_whole]
    got = {r.doc_id for r in truncation.truncated(docs(spark, texts)).where("is_cut").collect()}
    want = {*range(300, 300 + len(cuts) + 1), len(texts) - 151}
    assert got == want
    shares = truncation.truncation_shares(docs(spark, texts)).first()
    assert shares.n_cut == len(want) and shares.n_texts == len(texts) - 3
    assert truncation.truncated(docs(spark, [])).count() == 0


def test_cut_within_a_long_address(spark):
    address = "site.office.and.document.control@northern-contractors.example"
    whole = [f"Please {w} write to {w}{w} {address} before the gate is locked." for w in ("".join(x) for x in zip("abcdefghijklmnopqrstuvwxyz" * 2, "nopqrstuvwxyzabcdefghijklm" * 2, strict=True))]
    texts = [*whole, f"The planner asks quickly {address[:45]}", f"The planner asks slowly {address}"]
    got = {r.doc_id for r in truncation.truncated(docs(spark, texts)).where("is_cut").collect()}
    assert got == {len(whole)}


def test_words_and_trigrams_are_cheap_and_the_same(spark):
    plain = r"[\\p{L}0.+-]++@[\\p{L}0.-]*+|[\\p{L}\\p{M}0&&[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]]++|[.!?。…:>-]|[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]"
    one = spark.range(0x110000).where("id not between 55296 and 57343").selectExpr("decode(unhex(case when id < 65536 then lpad(hex(id), 4, '0') else concat(hex(55296 + shiftright(id - 65536, 10)), hex(56320 + ((id - 65536) & 1023))) end), 'UTF-16BE') as c").selectExpr("c", "concat('a', c, 'b ', c, '.x@', c, '0') as t")
    words = lambda c, by: F.expr(f"regexp_extract_all({c}, '{by}', 0)")
    assert one.agg(F.countDistinct("c"), F.max(F.length("c"))).first() == (0x110000 - 2048, 1)
    assert one.where((words("c", plain) != words("c", truncation._WORD)) | (words("t", plain) != words("t", truncation._WORD))).count() == 0
    texts = [[], ["a"], ["a", "b", "c"], ["a", "b", "c", "d"], ["検", "b", "検", "b", "検", "b", "検", "."]]
    rows = spark.createDataFrame([(w, len(w)) for w in texts], "w array<string>, n int")
    inside = truncation._sql(truncation.INSIDE, words=rows)
    want = Counter((f"{w[i - 2]} {w[i - 1]}", w[i]) for w in texts for i in range(2, len(w) - 1))
    assert {(r.a, r.b): r.n for r in inside.collect()} == want
    assert "lambda" not in inside._jdf.queryExecution().optimizedPlan().toString(), "each trigram is interpreted"
    scripts = truncation._WORD.split("&&")
    assert len(scripts) == 3 and scripts[1].startswith(r"[\\x00-\\u2E7F["), "the script of each letter is searched for"


def test_damage_without_suspect_characters_does_not_teach_the_model(spark):
    clean = [c.format(i) for i in range(200) for c in CLEAN]
    sly = [f"Wykoñczenie {i}" for i in range(3)]
    rows = clean + [f"Wykończenie {i}" for i in range(900)] + sly + ["Helgskift – kväll 3"] * 4
    got = {r.name: (r.restored, r.by_model) for r in mojibake.garbled(names(spark, rows)).collect()}
    assert got == {f"Wykoñczenie {i}": (f"Wykończenie {i}", True) for i in range(3)}


def test_every_clean_name_counts_for_the_margin(spark):
    clean = [f"Ã {a}{b}{c}{d} m³" for a in "aeiou" for b in "lmnprst" for c in "aeiou" for d in "lmnpr"] + ["ó"]
    rows = names(spark, [*clean, *["ó"] * 29, "Ã³"])
    # The damage of one short name among 876 gains little, which lowers the margin for all.
    assert [(r.name, r.restored) for r in mojibake.garbled(rows).collect()] == [("Ã³", "ó")]
    told, margin = mojibake.scored(mojibake.shapes_of(rows))
    assert {r["shape"] for r in told.where("clean").select("shape").collect()} == set(clean)
    model = mojibake.train(mojibake.shapes_of(rows.where("name <> 'Ã³'")))
    good, bad = [model.best(x)[0] for x in clean], [model.best(h)[0] for x in clean for h in mojibake.damaged(x)]
    errors = {m: 5 * sum(g > m for g in good) / len(good) + sum(b <= m for b in bad) / len(bad) for m in mojibake.LEVELS}
    best = [m for m, e in errors.items() if e <= min(errors.values()) + 1e-9]
    assert len(bad) >= 8 * len(clean) and margin == best[len(best) // 4]


def test_digits_return_to_their_places(spark):
    df = spark.createDataFrame([("a00b0", "a12b3"), ("0", "7"), ("ab", "ab"), ("a0", "a"), (None, "1")], "shape string, name string")
    assert [r[0] for r in df.select(mojibake.with_digits(F.col("shape"), F.col("name"))).collect()] == ["a12b3", "7", "ab", None, None]
