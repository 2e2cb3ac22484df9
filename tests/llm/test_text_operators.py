import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ann, cotrain, credentials, decontam, langid, url_templates


# Decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(own) - k + 1):
                if own[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def benchmark_case():
    rnd = random.Random(2)
    words = lambda k: " ".join(rnd.choice(["a", "b", "Zé", "x1", "漢"]) for _ in range(k))
    items = [(i, words(rnd.randint(10, 30))) for i in range(8)] + [(9, "short one"), (10, None), (11, ""), (9, "short one"), (12, "...")]
    docs = [(d, ", ".join(rnd.choice([words(12), items[rnd.randrange(8)][1].upper(), "Short, ONE!"]) for _ in range(rnd.randint(0, 4)))) for d in range(30)]
    return items, [*docs, (30, None), (31, ""), (3, docs[3][1]), (None, docs[4][1])]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items, docs = benchmark_case()
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, hits string")
    found = sorted(map(tuple, decontam.report(df, b).collect()), key=str)
    want = []
    for d, t in docs:
        n, hit, who = brute_hits(t, items)
        want.append((d, n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), hit > 0))
    assert found == sorted(want, key=str)
    clean = decontam.without_benchmark(df, b)
    assert clean.columns == df.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontam.report(df.limit(0), b).count() == 0
    assert decontam.report(df, b.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_count_as_one(spark):
    text = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, text), (None, text + " more"), (7, text)], "item_id long, text string")
    row = decontam.report(spark.createDataFrame([(1, "x " + text)], "doc_id long, text string"), items).first()
    assert row.n_hit == 12 and row.n_items == 2 and row.items_sha256 == hashlib.sha256(b"7").hexdigest()


# Languages


def test_language_on_held_out_texts(spark):
    rnd = random.Random(3)
    stems = {"aa": ["thor", "ing", "ed", "whe", "oun"], "bb": ["eau", "ment", "oir", "que", "çon"], "cc": ["ung", "sch", "keit", "ßer", "ü"]}
    word = lambda lang: "".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(rnd.randint(5, 300))), lang) for i, lang in enumerate(rnd.choices(list(stems), [8, 1, 1], k=600))]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 --", "aa"), (1003, rows[0][1], None), (None, rows[1][1], "bb")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + extra], "doc_id long, text string, lang string, score double")
    out = {r.row.doc_id: r for r in langid.predict(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([out[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1003].lang_pred == rows[0][2]
    none = langid.predict(df.limit(0))
    assert none.count() == 0
    unlabelled = langid.predict(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_short_texts_tie_to_the_frequent_language():
    own = langid.Compressors({"often": ["abc def"], "seldom": ["abc def"]})
    assert own.predict("xyz") == ("often", 0.0)
    assert langid.Compressors({"one": ["abc"]}).predict("zzz") == ("one", 1.0)


# Secrets


def test_base_rules():
    cases = {
        "password = abcdefghijkl": [("assign", 0, 23)],
        "PassWd:\"abcdefghijkl\"": [("assign", 0, 20)],
        "secret: token: abcdefghijklmnop": [],  # the first match takes the second key
        "api_key=abcdefghijkl apikey=abcdefghijk": [("assign", 0, 20)],
        "to\u212aen=abcdefghijkl": [],  # the Kelvin sign is no k
        "AKIA12345678901234": [("access", 0, 18)],
        "AKIA1234567890123": [],
        "é 0123456789abcdef0": [("hex", 2, 19)],
        "0123456789ABCDEF": [],
        "": [],
    }
    for text, want in cases.items():
        assert credentials.scan(text)[0] == want, text


def test_linking_needs_complementary_parts():
    alone = "client_id = user-77"
    assert credentials.scan(alone)[1] == []
    assert credentials.scan("see https://db.example.com/x now")[1] == []
    both = alone + " with pwd = hunter22x"
    assert [k for k, _, _ in credentials.scan(both)[1]] == ["weak_identifier", "weak_secret"]
    assert credentials.scan(alone + "\n\npwd = hunter22x")[1] == []  # another scope
    assert credentials.scan(alone + " x" * 200 + " pwd = hunter22x")[1] == []  # out of reach
    strong = "token = abcdefghijklmnop at 10.0.0.1"
    base, every = credentials.scan(strong)
    assert [k for k, _, _ in base] == ["assign"] and [k for k, _, _ in every] == ["assign", "weak_endpoint"]


def test_bare_keys_are_linked():
    key = "wJa9rXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY"
    for before, other in (("", "AKIA12345678901234"), ("", "AKIA1234567890"), ("aws_key=", "db.example.com is https://db.example.com/x"), ("", "10.0.0.1:5432")):
        text = f"{other} {before}{key} rest"
        at = text.index(key)
        strong, every = credentials.scan(text)
        assert ("weak_secret", at, at + len(key)) in every and ("weak_secret", at, at + len(key)) not in strong
        assert key not in credentials.redacted(text, every)
        assert credentials.scan(f"{other} and prose\n\n{key}")[1] == credentials.scan(f"{other} and prose")[1]  # another scope
    assert credentials.scan(f"{key} alone")[1] == []
    assert credentials.scan(f"https://example.com/{key}")[1] == [] and credentials.scan(f"client_id = {key}")[1] == []  # one part, not two


def test_nested_parts_reach_by_their_furthest_end():
    token = "token = zz-0123456789abcdef-" + "Zq-" * 70
    base, every = credentials.scan(f"{token} 10.0.0.1")
    assert [k for k, _, _ in base] == ["assign", "hex"] and [k for k, _, _ in every] == ["assign", "hex", "weak_endpoint"]


def test_link_like_brute_force():
    rnd = random.Random(4)
    parts = ["client_id = ab12", "pwd = hunter22x", "token = abcdefghijklmnop", "10.0.0.1", "AKIA12345678901234", "\n\n", "prose words " * 8, "login: somebody"]
    need = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret", "identifier")}
    role = credentials._ROLE
    for _ in range(300):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        strong, every = credentials.scan(text)
        weak = credentials.weak_spans(text, text.lower())
        scope = lambda a: len([m for m in re.finditer(r"\n[ \t]*\n", text) if m.start() < a or m.start() == a])
        free = [w for w in weak if not any(a < w[2] and w[1] < b for _, a, b in strong)]
        want = set()
        for kind, a, b in free:
            for other, x, y in [*strong, *free]:
                if role[other] in need[role[kind]] and x - b <= credentials.REACH and a - y <= credentials.REACH and scope(x) == scope(a):
                    want.add((kind, a, b))
        assert set(every) - set(strong) == want, text


def test_report_and_redaction(spark):
    rows = [(1, "a token = abcdefghijklmnop b", 29), (2, None, 0), (3, "", 0), (4, "plain", 5), (4, "plain", 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars long, spans string")
    found = {r.row.doc_id: r for r in credentials.report(df).collect()}
    assert found[1].n_assign == 1 and found[1].spans == "assign:2:26" and found[1].base_sha256 == hashlib.sha256(b"assign:2:26").hexdigest()
    assert found[2].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest() and found[4].row.spans == "x"
    clean = {r.doc_id: r for r in credentials.redact(df, length_col="n_chars").collect()}
    assert clean[1].text == "a [REDACTED] b" and clean[1].n_chars == 14 and clean[2].text is None and clean[4].n_chars == 5
    assert credentials.report(df.limit(0)).count() == 0


# URLs


def brute_rule(host, path):
    best = None
    for name, prefix, verdict in url_templates.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
            best = (name + prefix, verdict)
    return best


def test_urls_like_brute_force(spark):
    rnd = random.Random(6)
    urls = ["", None, "no scheme", "http://", "HTTP://Example.NET/en/a?x#y", "http://net", "http://a.b.net?q", "x://badexample.net/en/", "y://org/fr/z", "a://b://c.org/fr/", "z://h.com/q#://d.net/", "http://É.NET/"]
    urls += [f"https://{rnd.choice(['a.', 'www.', ''])}{rnd.choice(['example.com', 'example.net', 'x.org', 'q.net'])}/{rnd.choice(['de', 'en', 'fr', 'u', ''])}/{rnd.randint(1, 500)}" for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string")
    rows = {r.row.page_id: r for r in url_templates.judge(df).collect()}
    assert len(rows) == len(urls) + 3
    labels = {}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        rule = brute_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule[0]), u
        if rule:
            assert rows[i].verdict == rule[1]
        else:
            labels[i] = rows[i].verdict
    assert set(labels.values()) <= {"allow", "block"}
    assert url_templates.judge(df.limit(0)).count() == 0


def test_similar_unlabelled_urls_follow_their_template(spark):
    """Numbers under a host, nearly all labelled bad: the rest of these goes too, other structures and hosts stay."""
    rules = [("h.com", "/p/1", "block"), ("h.com", "/z", "allow")]
    urls = [f"http://h.com/p/{i}" for i in range(100, 200)] + [f"http://h.com/p/{i}" for i in range(20, 24)] + [f"http://h.com/q/{'ab'[i % 2]}-slug" for i in range(50)]
    urls += [f"http://h.com/z/{i}" for i in range(40)] + [f"http://i.com/p/{i}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.row.page_id: r for r in url_templates.judge(df, rules=rules).collect()}
    assert all(rows[i].verdict == "block" for i in range(104)) and all(rows[i].verdict == "allow" for i in range(104, 199))
    assert rows[1].rule == "h.com/p/1" and rows[101].rule is None and rows[100].template == rows[103].template == "/p/{n}"


def written_class(segment):
    extension = (re.search(r"(?s)[^.](\.[A-Za-z][A-Za-z0-9]{0,4})$", segment) or [None, ""])[1]
    stem = segment[: len(segment) - len(extension)]
    kinds = [("{n}", r"[0-9]+"), ("{u}", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), ("{h}", r"(?=.*[0-9])[0-9a-fA-F]{12,}"), ("{x}", r"(?s).*[0-9].*")]
    return next((k for k, p in kinds if re.fullmatch(p, stem)), "{w}") + extension.lower()


def brute_tree(urls):
    """{(host, path): purity} for (host, path, verdict or None): one node at a time, by recursion."""
    out = {}

    def wilson(b, n):
        p, z = b / n, 1.96
        middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        return middle - half, middle + half

    def grow(host, members):  # members: (segments left, path, verdict)
        by = {}
        for m in members:
            by.setdefault(m[0][0] if m[0] else "", []).append(m)
        labels, usual = {}, {}
        for segment, own in by.items():
            kind = written_class(segment) if segment else ""
            label = "" if not segment else "=" + segment if len(own) >= len(members) / 16 else "~" + kind
            labels.setdefault(label, (kind, []))[1].extend(own)
            after = Counter("/".join(written_class(s)[:3] for s in m[0][1:]) for m in own)
            usual.setdefault(label, []).append((len(own), max(after, key=lambda a: (after[a], a))))
        alike = {}
        for label, (kind, own) in labels.items():
            alike.setdefault((kind, max(usual[label])[1]), []).append((label, own))
        for groups in alike.values():
            told, silent = [], []
            for label, own in groups:
                marks = [m[2] for m in own if m[2]]
                (told if marks else silent).append((*(wilson(marks.count("block"), len(marks)) if marks else ()), label, own))
            islands, top = [], None
            for low, high, _, own in sorted(told, key=lambda t: (t[0], t[2])):
                if top is None or low > top:
                    islands.append([])
                islands[-1] += own
                top = high if top is None else max(top, high)
            rest = [m for _, own in silent for m in own]
            if len(islands) == 1:
                islands[0] += rest
            elif rest:
                islands.append(rest)
            for branch in islands:
                marks = [m[2] for m in branch if m[2]]
                for segments, path, _ in branch:
                    if not segments:
                        out[host, path] = (marks.count("block") + 1.2) / (len(marks) + 4)
                longer = [(m[0][1:], *m[1:]) for m in branch if m[0]]
                if longer:
                    grow(host, longer)

    for host in {u[0] for u in urls}:
        grow(host, [([s for s in p.split("/") if s], p, v) for h, p, v in urls if h == host])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_like_a_brute_force_tree(spark, seed):
    rnd = random.Random(seed)
    part = lambda: rnd.choice([str(rnd.randint(1, 900)), rnd.choice(["de", "en", "fr"]), f"a{rnd.randint(1, 5)}", f"{rnd.randint(1, 40)}.html", "%012x" % (rnd.getrandbits(40) | 1 << 44), "slug-" + "xyz"[rnd.randrange(3)]])
    urls = [f"http://{rnd.choice(['h.com', 'i.com', 'j.com'])}/{rnd.choice(['de', 'en', 'fr', 'es', 'u'])}/" + "/".join(part() for _ in range(rnd.choice([0, 1, 1, 1, 3]))) for _ in range(400)]
    urls += urls[:40] + ["nothing", None]
    rules = [("h.com", "/de/", "block"), ("h.com", "/fr/1", "allow"), ("i.com", "/en/2", "block"), ("i.com", "/u/", "allow"), ("j.com", "/de/", "block")]
    found = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), rules=rules).collect()
    verdicts = [v for _, _, v in rules]
    names = [h + p for h, p, _ in rules]
    want = brute_tree([(r.host, r.path, verdicts[names.index(r.rule)] if r.rule else None) for r in found])
    assert len(found) == len(urls) and all(r.purity == pytest.approx(want[r.host, r.path], abs=1e-6) for r in found)
    assert all(r.verdict == ("block" if want[r.host, r.path] >= url_templates.REJECT else "allow") for r in found if not r.rule)
    assert {r.verdict for r in found if not r.rule} == {"allow", "block"}


# Neighbours


@pytest.mark.parametrize("n", [0, 1, 5, 900, 3000])
def test_neighbours_recall(spark, n):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(n, 16)) + 3 * rnd.normal(size=(8, 16))[rnd.integers(0, 8, n)]
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(10_000, None, "x"), (10_100, [0.0] * 16, "x"), (10_200, [float("nan")] * 16, "x"), (10_300, [1.0], "x"), (10_400, [None, *[1.0] * 15], "x"), *rows[:1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    found = {}
    for r in ann.search(df, (ann.F.col("id") % 100) == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i in range(0, n, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = np.lexsort((np.arange(n), d))[: min(10, n - 1)].tolist()
        own = sorted(found.get(i, []))
        assert [r for r, _, _ in own] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx(d[j]) for _, j, s in own) and [s for _, _, s in own] == sorted(s for _, _, s in own)
        hit += len({j for _, j, _ in own} & set(want))
        total += len(want)
    assert hit >= 0.9 * total


def test_equal_vectors_tie_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = ann.search(df, ann.F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == list(range(1, 11)) and {r.score for r in rows} == {0.0}


def test_repeated_rows_are_one_neighbour(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(12 if i % 10 == 1 else 2)] + [(7, (x[0] + 9).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, (ann.F.col("id") % 20) == 0).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert len(found) == 3
    for i, own in found.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert own == np.argsort(d, kind="stable")[:10].tolist()


# Quality


def test_quality_of_unseen_documents(spark):
    rnd = random.Random(8)
    clean = lambda: " ".join(rnd.choice(["river", "stone", "light", "tree", "wind"]) for _ in range(60)) + "."
    junk = lambda: " ".join(rnd.choice(["BUY", "NOW", "###", "$$$", "!!"]) for _ in range(60))
    rows = [(i, (junk if i % 4 == 0 else clean)(), "en", f"s{i % 5}", 300) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (None, "x", "en", "s", 1), (5, *rows[5][1:])], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300)] + [(7, 1, 0), (9, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    out = cotrain.scored(docs, labels)
    found = {r.doc_id: r for r in out.collect()}
    assert out.count() == 603 and all(0 <= r.score <= 1 for r in found.values())
    assert np.mean([found[i].keep == (i % 4 != 0) for i in range(300, 600)]) > 0.98
    assert cotrain.scored(docs.limit(0), labels).count() == 0
    flat = cotrain.scored(docs, labels.where("quality = 1"))
    assert flat.where("keep").count() == 603
