"""Line rules, toxicity, fingerprints and mixing against brute force, held-out accuracy and SQL."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terragrid.llm import fingerprints, line_rules, mixing, queries, toxicity
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, ""), (2, None), (3, " \n\t "), (4, "a b c"), (5, "a b c"), (6, "x " * 4000), (7, "é ü\nñ\n\né ü\nñ"), (None, "lost id " * 30), (9, "| menu | home | login |\nOne two three. " + "word " * 30)]


def edge(spark, rows=EDGE):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash")).withColumn("kept", F.lit(1))


def brute_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_line_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge(spark).select("doc_id", "text").where("doc_id is null or doc_id < 10").selectExpr("doc_id + 100000", "text"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in line_rules.clean_lines(docs).collect():
        want = brute_counts(text[r.doc_id])
        assert tuple(r[c] for c in line_rules.COUNTS) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_line_rules_drop_navigation_and_keep_prose(spark):
    got = {r.doc_id: r for r in line_rules.clean_lines(edge(spark)).collect()}
    assert got[9].removed == ["navigation"] and got[9].kept is False  # 30 times one word repeats
    assert got[2].n_words == 0 and not got[2].kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    out = line_rules.clean_lines(spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id")).where("not base_failed")
    assert out.where("kept").count() >= 0.98 * out.count()


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    test = got[got.held_out]
    assert (test.predicted == test.toxic).mean() > 0.95


def test_toxicity_folds_and_spares_exceptions(spark):
    lexicon = toxicity.Lexicon({" idiot": 6.0, " trash ": 5.0})
    rows = [(1, "You 1DіOTS!"), (2, "the trash can is full"), (3, "what trash"), (4, None), (5, ""), (6, "patriot idea")]
    got = {r.doc_id: r.score for r in toxicity.score(edge(spark, rows), lexicon).collect()}
    assert got[1] > 0.5 and got[3] > 0.5 and got[2] == got[4] == got[5] == got[6] < 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(edge(spark, rows), empty).weights == {}


def test_mixing_matches_sql_and_target(spark):
    sf = SF.replace("0.001", "0.01")
    got = sorted(map(tuple, queries.op10_mixing(spark, sf).collect()))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(db.sql(queries.ORACLES["op10_mixing"]).fetchall())
    assert got == want
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", 7) for i in range(20000)], "doc_id long, source string, extra int")
    n = {r.source: r.n for r in mixing.replicate(docs, {"a": 1.0, "b": 3.0, "c": 9.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["b"] / n["a"] - 3) < 0.15 and abs(sum(n.values()) - 20000) < 600
    assert "extra" in mixing.replicate(docs, {"a": 1.0}).columns
    nulls = spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, source string")
    assert mixing.replicate(nulls, epochs=3.0).count() >= 0
    assert mixing.replicate(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(docs, {"a": -1.0})


def test_mixing_of_rare_sources(spark):
    """One row beside 200,000 (a mean near 100), and means far past where exp(-mean) is zero."""
    docs = spark.range(200_001).selectExpr("id doc_id", "if(id = 200000, null, concat('s', id % 20)) source")
    got = sorted(map(tuple, mixing.replicate(docs).where("source is null").select("doc_id", "copy", "mix_copies", "mix_key").collect()))
    db = duckdb.connect()
    db.sql("create view documents as select range doc_id, if(range = 200000, null, 's' || (range % 20)) source from range(200001)")
    want = sorted(db.sql(f"select * from ({mixing.sql('documents', 20240, 0.5, 256.0, 'doc_id, copy, mix_copies, mix_key, source')}) where source is null").fetchall())
    assert len(got) > 64 and got == [r[:4] for r in want]
    unit = lambda i: int(hashlib.md5(f"20240|{i}".encode()).hexdigest()[:13], 16) / 2**52
    for mean in (390.0, 410.0, 5000.0):
        few = spark.createDataFrame([(i, "r") for i in range(20)], "doc_id long, source string")
        n = {r.doc_id: r.mix_copies for r in mixing.replicate(few, {"r": 1.0}, epochs=mean).select("doc_id", "mix_copies").distinct().collect()}
        total, k, at = 0.0, -1, {}
        for i in sorted(range(20), key=unit):
            while total <= unit(i):
                k += 1
                total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            at[i] = k
        assert n == at


def jaccard(a, b):
    x, y = (collections.Counter(WORD.findall(t)) if WORD.findall(t) else collections.Counter([""]) for t in (a, b))
    return sum(min(x[k], y[k]) for k in x | y) / sum(max(x[k], y[k]) for k in x | y)


def test_fingerprints_estimate_generalised_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(edge(spark, EDGE[:7]).selectExpr("doc_id + 100000", "text"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(text, reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare(docs, samples=64, buckets=7).collect()}
    assert sorted(got) == sorted(text)
    off = []
    for i, d in enumerate(order):
        t, n = text[d], text[order[(i + 1) % len(order)]]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, n)]
    assert abs(sum(off) / len(off)) < 0.02 and sum(x * x for x in off) / len(off) < 0.06**2
    assert got[100004].fingerprint == got[100005].fingerprint and got[100001].fingerprint == got[100003].fingerprint
    assert fingerprints.compare(docs.limit(0), buckets=3).count() == 0
    assert fingerprints.compare(edge(spark), buckets=3).count() == len(EDGE)


def test_columns_may_have_any_name(spark):
    """Extra columns named like an operator's own, inside or out: those that it adds are replaced, others kept."""
    from terragrid.llm import mixing, substrings

    rows = [(i, f"word{i} " * 40, "s") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("row", "ROW_", "spans", "n_words", "other_row", "start", "anchor", "_row"):
        out = substrings.remove(docs.withColumn(c, F.lit("x")))
        assert out.count() == 6 and {r[c] for r in out.collect()} == ({40} if c == "n_words" else {"x"})
    for c in ("copy", "mix_source", "_u", "mix_unit", "mix_cdf", "rate", "m"):
        out = mixing.replicate(docs.withColumn(c, F.lit("x")), epochs=3.0)
        assert {r[c] for r in out.collect()} == ({"x"} if c != "copy" else {r.copy for r in out.collect()}) and out.count() > 0


def test_kept_equals_a_plain_version_of_the_rules(spark):
    from terragrid.llm import line_rules

    rules = line_rules.LineRules()
    menu = set(rules.navigation)

    def fails(line, last):
        words = line.split()
        if not words:
            return False
        bare = [re.sub(r"\W", "", w.lower()) for w in words]
        entries = "|".join(re.escape(e) for e in sorted(menu, key=len, reverse=True))
        if sum(w in rules.separators for w in words) > 0.2 * len(words) or re.sub(rf"\b(?:{entries})\b|[\W_]", "", line.lower()) == "" and any(bare):
            return True
        if any(b in line.lower() for b in rules.boilerplate) or sum(c in "#*$%&|<>" for c in line) > 0.15 * len(line):
            return True
        cased = [c for c in line if c.isupper() or c.islower()]
        if len(cased) >= 20 and sum(c.isupper() for c in cased) > 0.7 * len(cased):
            return True
        return len(words) >= 5 and not last and line.rstrip()[-1] not in rules.terminal

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.base_failed, r.kept) for r in line_rules.clean_lines(docs).collect()}
    for r in docs.collect():
        lines = r.text.split("\n")
        size = lambda t: len(re.sub(r"[\x20\x09-\x0D]", "", t))
        lost = sum(size(t) for i, t in enumerate(lines) if fails(t, i == len(lines) - 1))
        failed = got[r.doc_id][0]
        assert got[r.doc_id][1] == (not failed and lost <= 0.5 * size(r.text)), r.doc_id
    prose = {
        1: "春天来了，城市里的花园慢慢恢复了颜色，人们在河边散步，孩子们追着风筝跑过草地。\n老人坐在长椅上谈论去年的雨水和今年的收成，街角的小店重新开张。",
        2: "朝早くから市場には人が集まり、新鮮な魚や野菜を選ぶ声が通りに響いていた。\n昼になると雨が降り始め、店の人たちは急いで品物を屋根の下に移した。",
        3: "في الصباح الباكر خرج الناس إلى السوق لشراء الخضار والفواكه الطازجة من المزارعين.\nهل كان الطقس جميلا في ذلك اليوم من أيام الربيع الطويلة؟",
        4: "सुबह के समय लोग नदी के किनारे टहलने जाते हैं और पक्षियों की आवाज़ सुनते हैं।\nबच्चे मैदान में खेलते हैं और बूढ़े लोग पेड़ की छाया में बैठकर बातें करते हैं।",
        5: "THIS WHOLE TEXT IS SHOUTED AT THE READER WITHOUT PAUSE.\nAND SO IS THE SECOND OF ITS LINES, Quite LOUDLY.",
    }
    rows = spark.createDataFrame(list(prose.items()), "doc_id long, text string")
    for r in line_rules.clean_lines(rows).collect():
        want = [v for v in (fails(t, i == 1) for i, t in enumerate(prose[r.doc_id].split("\n"))) if v]
        assert r.n_lines_removed == len(want) == (2 if r.doc_id == 5 else 0) and (r.removed == ["shouting"] * 2 or r.doc_id != 5)
        assert r.text == ("" if r.doc_id == 5 else prose[r.doc_id])
    made = spark.createDataFrame([(1, "Home About Contact\nLogin Register Help Home About\nNext Previous Search | Sitemap FAQ Help Home About\n" * 3)], "doc_id long, text string")
    row = line_rules.clean_lines(made).head()
    assert row.n_lines_removed == 9 and not row.kept


def test_fitted_weights_equal_a_plain_version(spark):
    """Document frequencies of every word and beginning by hand; the log-odds; no term left out but by the stated bounds."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    text = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    df, n = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter(r.toxic for r in labels.collect())
    for r in labels.collect():
        terms = set()
        for word in toxicity.fold(text[r.doc_id]).split():
            terms |= {f" {word} "} | {f" {word[:k]}" for k in range(4, 9) if k < len(word)}
        df[r.toxic].update(terms)
    odds = {t: math.log((c + 0.5) / (n[1] + 1)) - math.log((df[0][t] + 0.5) / (n[0] + 1)) for t, c in df[1].items() if c >= max(2, 0.01 * n[1])}
    want: dict = {}
    for t in sorted(odds, key=lambda t: (len(t), t)):
        if odds[t] >= 2.5 and odds[t] > 1 + max([want[t[:k]] for k in range(2, len(t)) if t[:k] in want], default=-1.0):
            want[t] = round(odds[t], 4)
    assert want and toxicity.fit(docs, labels).weights == want


def test_toxicity_equals_a_plain_version(spark):
    """Scores of a fitted lexicon recomputed word by word: folding, weights, exceptions, length."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(90_001, "Ｔrash can, trаsh t4sh \u200bclown fish", "en", "s", 1), (90_002, None, None, None, None), (90_003, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    fitted = toxicity.fit(docs, labels)
    lexicon = toxicity.Lexicon(fitted.weights | {" trash ": 3.0, " clow": 2.0}, fitted.exceptions, fitted.bias, fitted.slope)

    def fold(text):
        out = []
        for c in text:
            c = chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c
            c = c.lower()
            c = toxicity.HOMOGLYPHS.get(c, toxicity.SUBSTITUTES.get(c, c))
            out.append(c if c.isalpha() else "" if c in "\u200b\u200c\u200d\u00ad\ufeff" else " ")
        return " " + "".join(out) + " "

    def density(text):
        t, total = fold(text), 0.0
        spared = {k for p in lexicon.exceptions for m in re.finditer(f"(?= {re.escape(p)} )", t) for k in range(m.start(), m.start() + len(p) + 2)}
        for m in re.finditer(" (?=[^ ])", t):
            fit = [w for term, w in lexicon.weights.items() if t.startswith(term, m.start())]
            if fit and m.start() not in spared:
                total += max(fit)
        return 100 * total / max(20, t.count(" ") - 1) if total else 0.0

    for r in toxicity.score(docs, lexicon).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = density(r.text or "")
        assert abs(r.density - want) < 1e-6 * max(1, want)
        assert abs(r.score - 1 / (1 + math.exp(-min(30, max(-30, lexicon.bias + lexicon.slope * math.log1p(want)))))) < 1e-9
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
