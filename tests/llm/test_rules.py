"""Quality rules, URL filter, license rules and source mixing against brute force and their oracles."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import no_docs, odd_docs, odd_rows, sentence_text

import __spark_entry__ as E
from staylens.llm import quality
from staylens.llm.common import stored
from staylens.llm.licenses import SENTENCES, scan_licenses
from staylens.llm.mixing import mix_sources, poisson_cdf, source_rates, uniform
from staylens.llm.oracles import ORACLE_SQL, license_sql, mixing_sql, url_sql
from staylens.llm.quality import count_grams, filter_quality, judge_quality, kneser_ney, perplexity_bands, word_rules
from staylens.llm.url_filter import filter_urls

SF = "/root/testdata/sf0.001"


def same_rows(df, relation):
    a = sorted(([str(x) for x in r] for r in df.select(*sorted(df.columns)).collect()))
    cols = sorted(relation.columns)
    b = sorted(([str(x) for x in r] for r in relation.project(", ".join(f'"{c}"' for c in cols)).fetchall()))
    assert sorted(df.columns) == cols and a == b


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_oracle(spark, duck, key):
    same_rows(E.queries()[key](spark, SF), duck.sql(E.oracle_sql()[key]))


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_word_rules():
    rnd = random.Random(8)
    for _ in range(300):
        t = "".join(rnd.choice(["a", "b ", "\n", " ", "é\u00a0", "#|", "ab ab ab ", "\t", "\x1c", "🙂 "]) for _ in range(rnd.randint(0, 60)))
        assert word_rules(t.encode()) == brute_rules(t)


def brute_kneser_ney(texts):
    """ln p of every character 4-gram of the texts (with three start signs and an end sign)."""
    c = {4: Counter()}
    for t in texts:
        s = "\x02" * 3 + "".join(x if ord(x) < 65536 else "�" for x in t.lower()) + "\x03"
        c[4].update(s[i:i + 4] for i in range(len(s) - 3))
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    p = q = {"": 1 / (len(c[1]) + 1)}
    for k in (1, 2, 3, 4):
        n = Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)] if all(n[i] for i in (1, 2, 3, 4)) else [y] * 3
        total, rest = Counter(), defaultdict(float)
        for g, m in c[k].items():
            total[g[:-1]] += m
            rest[g[:-1]] += d[min(m, 3) - 1]
        new_p, new_q = {}, {}
        for g, m in c[k].items():
            t, r, tail = total[g[:-1]], rest[g[:-1]] / total[g[:-1]], "" if k == 1 else g[1:]
            new_p[g] = (m - d[min(m, 3) - 1]) / t + r * p[tail]
            lower = q[tail] if m == 1 else p[tail]  # without one occurrence of g
            new_q[g] = lower if t == 1 else (m - 1 - (d[min(m - 1, 3) - 1] if m > 1 else 0)) / (t - 1) + r * lower
        p, q = new_p, new_q
    return {g: math.log(x) for g, x in q.items()}


def test_language_model_is_kneser_ney(spark):
    rows = [(r[2], r[1]) for r in odd_rows()]
    grams = stored(count_grams(spark.createDataFrame(rows, "lang string, text string").repartition(3)), "grams")
    model = kneser_ney(grams).collect()
    for lang in {r[0] for r in rows}:
        want = brute_kneser_ney([t or "" for x, t in rows if x == lang])
        got = {"".join(chr(r.gram >> s & 0xFFFF) for s in (48, 32, 16, 0)): r.logp for r in model if r.lang == lang}
        assert got == pytest.approx(want)


def test_quality_of_awkward_rows(spark, monkeypatch):
    docs = odd_docs(spark)
    got = judge_quality(docs).collect()
    rules = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr)
    assert rules == sorted(((r[0], *brute_rules(r[1] or "")) for r in odd_rows()), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    text = {r[0]: r[1] for r in odd_rows()}
    model = brute_kneser_ney([r[1] or "" for r in odd_rows() if r[2] == "fr"])
    s = "\x02" * 3 + text[9] + "\x03"
    mean = -sum(model[s[i:i + 4]] for i in range(len(s) - 3)) / (len(s) - 3)
    assert next(r.log_perplexity for r in got if r.doc_id == 9) == pytest.approx(mean, abs=6e-4)
    kept = filter_quality(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert judge_quality(no_docs(spark)).count() == filter_quality(no_docs(spark)).count() == 0
    # The model in several shards, and texts in several windows, give the same scores.
    import staylens.llm.quality as Q
    monkeypatch.setattr(Q, "SHARD_GRAMS", 700)
    monkeypatch.setattr(Q, "WINDOW_CHARS", 1000)
    again = judge_quality(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_perplexity_bands_reject_other_writing_and_keep_the_rest(spark):
    rnd = random.Random(2)
    rows = [(i, sentence_text(rnd, rnd.randint(60, 200)), "en") for i in range(300)]
    odd = "".join(chr(rnd.randrange(0x21, 0x2FF)) + (" " if rnd.random() < 0.2 else "") for _ in range(600))
    rows += [(1000, odd, "en"), (1001, " ".join("".join(rnd.choice("qxzjk") for _ in range(6)) for _ in range(80)), "en")]
    got = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000] and not got[1001] and all(got[i] for i in range(300))


def test_perplexity_bands_hold_when_a_third_of_a_language_is_unlike(spark):
    rnd = random.Random(3)
    rows = [(i, sentence_text(rnd, rnd.randint(60, 200)), "en") for i in range(200)]
    signs = ["{", "}", "();", "=>", "x1", "0x%04X", "&&", "||", "!=", "ret_", "++i", "[k]", "#define"]
    rows += [(1000 + i, " ".join(rnd.choice(signs).replace("%04X", f"{rnd.randrange(65536):04X}") for _ in range(rnd.randint(60, 200))), "en")
             for i in range(90)]
    rows += [(2000 + i, " ".join(["to be fair we said so again and then left"] + [f"w{j}" for j in range(60)]), "en") for i in range(300)]
    # Text like nothing else in its language: letters out of order, and letters at random.
    rows += [(3000 + i, " ".join("".join(rnd.sample(w, len(w))) for w in sentence_text(rnd, 120).split()), "en") for i in range(3)]
    rows += [(4000, " ".join("".join(rnd.choice("wvyhgfbp") for _ in range(6)) for _ in range(80)), "en")]
    got = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in (3000, 3001, 3002, 4000))


def test_perplexity_bands_are_median_and_deviation_of_distinct_rows(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["en", None]), rnd.randrange(60, 64), 0, 0, 0, 0, round(rnd.gauss(1.5, 0.2), 2)) for _ in range(200)]
    schema = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"
    got = {r["of"]: (r.low, r.high) for r in perplexity_bands(spark.createDataFrame(rows, schema)).collect()}
    for lang in ("en", None):
        x = np.array([r[-1] for r in set(rows) if r[0] == lang])
        reach = max(0.4, 12 * np.median(np.abs(x - np.median(x))))
        assert got[lang] == pytest.approx((np.median(x) - reach, np.median(x) + reach))
    # A third of the rows in a mode of their own, and copies of one row: the band stays about the others.
    rows = [("en", 60 + i, 0, 0, 0, 0, 1.5 + i % 5 / 100) for i in range(200)] + [("en", 900 + i, 0, 0, 0, 0, 2.6 + i % 9 / 100) for i in range(100)]
    rows += [("en", 50, 0, 0, 0, 0, 2.9)] * 500
    low, high = perplexity_bands(spark.createDataFrame(rows, schema)).first()[1:]
    assert 1 < low < 1.5 and 1.55 < high < 2.5


URLS = [(1, "HTTP://Sub.Example.ORG/es/x?y"), (2, "http://example.org"), (3, None), (4, "no scheme"), (5, ""),
        (6, "http://aexample.org/es/"), (7, "http://x.com/fr/a#b"), (8, "http://com/de/"), (9, "a://b://c/d"),
        (10, "http://example.org/en/12"), (11, "http://example.org/en/2"), (12, "x://É.NET/Ü?"), (12, "x://É.NET/Ü?"),
        (None, "http://spam.net/win/win"), (13, "http://foo.com/fr"), (14, "http://user@h.org:80/"), (15, "://"), (16, "x:///fr/\nde")]


def test_url_rules_and_hosts(spark, duck):
    rnd = random.Random(1)
    rows = URLS + [(100 + i, f"https://{rnd.choice(['news', 'shop', 'blog'])}{i % 7}.{rnd.choice(['org', 'net', 'com'])}/"
                         f"{rnd.choice(['fr', 'de', 'en', 'es'])}/{i % 13}") for i in range(400)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, score string")
    got = filter_urls(df).drop("score")
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert by[1] == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert by[2][:3] == ("example.org", "", None) and by[3] == ("", "", None, "allow") == by[4] == by[5]
    assert by[6][2:] == ("org/", "allow") and by[7][1:] == ("/fr/a", "com/fr/", "allow") and by[8][2:] == ("com/de/", "block")
    assert by[9][:2] == ("b:", "//c/d") and by[10][2] == "example.org/en/1" and by[11][2] == "org/" and by[12][:2] == ("É.net", "/Ü")
    assert by[14][2] is None and by[16][:2] == ("", "/fr/\nde")
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    same_rows(got, con.sql(url_sql()))
    assert filter_urls(df.where("false")).count() == 0


def test_url_tables_are_joined_by_shuffles(spark, monkeypatch):
    """a stored table counts as large as its file, so the driver was sent all its characters for a broadcast."""
    from staylens.llm import url_filter

    plans = []
    keep = url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df, name: plans.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    rows = [(i, f"http://a{i % 9}.example.{'org' if i % 3 else 'com'}/{'de' if i % 2 else 'en'}/{i}") for i in range(300)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert [n for n, _ in plans] == ["url-texts", "url-grams", "url-scores", "result"] and got.count() == 300
    assert all("BroadcastHashJoin" not in p for _, p in plans) and "SortMergeJoin" in plans[2][1] and "SortMergeJoin" in plans[3][1]


def test_url_models_tell_rejected_from_accepted(spark):
    rnd = random.Random(7)

    def host(kind):
        return f"{rnd.choice(['casino', 'bets', 'pills'] if kind else ['garden', 'library', 'school'])}-{rnd.choice('abcdefgh')}{rnd.randrange(99)}"
    rows, truth = [], {}
    for i in range(600):
        bad = rnd.random() < 0.5
        ruled = i < 400
        truth[i] = bad
        rows.append((i, f"http://{host(bad)}.{('bad' if bad else 'good') if ruled else 'net'}/p{rnd.randrange(9)}"))
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[("allow", "good/"), ("block", "bad/")]).collect()
    unruled = [r for r in got if r.rule is None]
    assert len(unruled) == 200 and sum((r.verdict == "block") == truth[r.page_id] for r in unruled) >= 190


def test_license_rules_follow_order(spark, duck):
    s = SENTENCES
    texts = ["\n".join([s["apache-notice-the-license"], s["apache-compliance"], s["apache-copy"], "  " + s["apache-url"]]),
             "\n".join([s["apache-compliance"], s["apache-notice-the-license"], s["apache-copy"], s["apache-url"]]),
             f"Text. {s['mit-released']} More! RELEASED   under the mit -- license\n{s['mit-title']}\nwords in between.\n{s['mit-notice']}",
             None, "", "Released under the MIT License, or not.", s["gpl-free"] + " " + s["gpl-hope"] + " " + s["gpl-see"],
             "MIT License\nAll rights reserved.\n" + s["mit-notice"]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (9, texts[2], "x"), (9, texts[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    by = {r.doc_id: dict(zip(r.licenses, r.matches)) for r in scan_licenses(df).collect()}
    assert by[0] == by[None] == {"Apache-2.0 header": 1} and by[1] == {} and by[2] == by[9] == {"MIT": 2, "MIT text": 1}
    assert by[3] == by[4] == by[5] == {} and by[6] == {"GPL-3.0-or-later notice": 1} and by[7] == {}
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    got = {(r[0], r[1]) for r in con.sql(license_sql()).fetchall()}
    assert got == {(i, ";".join(x)) for i, x in by.items()}
    assert scan_licenses(df.where("false")).count() == 0


def test_wrapped_license_notices_match(spark):
    import textwrap
    s = SENTENCES
    notices = {"GPL-3.0-or-later notice": s["gpl-free"] + "\n\n" + s["gpl-hope"] + " " + s["gpl-see"],
               "MIT text": s["mit-title"] + "\n\n" + s["mit-notice"],
               "BSD with rights reserved": s["rights-reserved"] + "\n\n" + s["bsd-redistribution"],
               "Apache-2.0 header": f"{s['apache-notice-the-license']} {s['apache-compliance']}\n{s['apache-copy']}\n\n    {s['apache-url']}",
               "MIT full text": s["mit-permission"] + "\n\n" + s["mit-notice"], "ISC": s["isc-permission"], "GPL-2.0-or-later": s["gpl2-free"],
               "LGPL-2.1-or-later": s["lgpl21-free"], "AGPL-3.0-or-later": s["agpl3-free"], "MPL-2.0": s["mpl-form"] + " 2.0. " + s["mpl2-copy"]}
    rows = []
    for name, text in notices.items():
        for before in ("", " * ", "# ", "// ", ";; "):
            lines = [x for part in text.split("\n") for x in (textwrap.wrap(part, 66) or [""])]
            rows.append((name, ("/*\r\n" if before == " * " else "") + ("\r\n" if before == "# " else "\n").join(before + x for x in lines)))
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert r.doc_id in r.licenses and set(r.matches) == {1}


def test_poisson_inversion(spark):
    from pyspark.sql import functions as F
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(poisson_cdf(F.lit(rate)).alias("c")).first().c
        p, term = [], -rate
        for k in range(len(cdf)):
            p.append(math.exp(term))
            term += math.log(rate) - math.log(k + 1) if rate else -math.inf
        assert cdf == pytest.approx([sum(p[:k + 1]) for k in range(len(cdf))]) and cdf[-1] > 1 - 1e-9
    u = [r.u for r in spark.range(4000).select(uniform(F.lit(1), F.col("id")).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.02


def test_mixture_has_the_target_weights(spark):
    rnd = random.Random(3)
    rows = [(i, sentence_text(rnd, 20), rnd.choice(["a"] * 8 + ["b"])) for i in range(6000)] + [(9000, "x", "left out")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, {"a": 1, "b": 3}, size=2.0).collect()
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text)
    total = sum(len(t) for _, t, s in rows)
    assert chars["a"] == pytest.approx(0.5 * total, rel=0.05) and chars["b"] == pytest.approx(1.5 * total, rel=0.05) and len(chars) == 2
    copies = Counter(r.doc_id for r in got)
    assert all(sorted(r.mix_copy for r in got if r.doc_id == d) == list(range(1, copies[d] + 1)) for d in list(copies)[:20])
    keys = [r.mix_key for r in got]
    assert keys == sorted(keys) and [r.doc_id for r in got[:50]] != sorted(r.doc_id for r in got[:50])


def test_mixing_of_awkward_rows(spark, duck):
    docs = odd_docs(spark)
    got = mix_sources(docs, seed=20)
    assert got.columns == docs.columns + ["mix_copy", "mix_key"]
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    assert set(rates) == {"a", "b", "c", "", None} and rates[""] == 1.0
    n = Counter((r.doc_id, r.text) for r in got.collect())
    per_row = Counter((r[0], r[1]) for r in odd_rows())
    assert all(k in per_row and v % per_row[k] == 0 for k, v in n.items())
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in odd_rows()])
    same_rows(mix_sources(docs.select("doc_id", "text", "lang", "source", "n_chars")), con.sql(mixing_sql()))
    assert mix_sources(no_docs(spark)).count() == 0


def test_the_model_is_made_by_small_plans(spark, monkeypatch):
    """The driver holds a plan, and a thread for each of its open shuffles, for as long as it runs."""
    shuffles = []

    def counted(df, name, **keep):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return stored(df, name, **keep)

    monkeypatch.setattr(quality, "stored", counted)
    judge_quality(odd_docs(spark)).count()
    assert max(shuffles) <= 12
