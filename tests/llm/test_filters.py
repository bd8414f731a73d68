"""URL verdicts, toxicity and decontamination, and their edge cases."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import decontaminate, toxicity, url_filter

# ---- URLs


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, rest[:cut]


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


URLS = [
    "http://a.NET/x?y=1", "https://example.net/en/1", "http://www.example.net/en", "http://net", "http://net/", "http://xnet/",
    "http://ÉX.example.com/de/1#f", "ftp://a.org/fr/", "http://a.org?x=/fr/", "http://a.org#/fr/", "://b.net/c", "nothing", "", None,
    "http://", "http:///de/", "http://example.com/de", "http://example.com/de/?a=b&c=d", "http://a.b://c.net/", "http://a.net:80/", "x" * 70_000,
]


@pytest.fixture
def pages(spark):
    def make(urls):
        return spark.createDataFrame([(i, u, "<p>", "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, risk double")

    return make


def test_parts_and_rules_match_plain_code(pages):
    rows = {r.page_id: r for r in url_filter.judge_pages(pages(URLS + URLS[:3])).collect()}
    assert len(rows) == len(URLS) + 3
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), url
        assert rows[i].verdict == (verdict or rows[i].verdict) and rows[i].verdict in ("allow", "block")


def test_trees_learn_what_the_spelling_shows(pages):
    rng = random.Random(0)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    urls = [f"http://{name(5)}.net/{'9' * 12}/{name(3)}?a=1&b=2" for _ in range(150)]
    urls += [f"http://{name(5)}.example.net/en/{name(6)}" for _ in range(150)]
    urls += [f"http://{name(5)}.info/{'9' * 12}/{name(3)}?a=1&b=2" for _ in range(20)]
    urls += [f"http://{name(5)}.info/en/{name(6)}" for _ in range(20)]
    rows = {r.page_id: r for r in url_filter.judge_pages(pages(urls)).collect()}
    free = [rows[i] for i in range(300, 340)]
    assert all(r.rule is None for r in free)
    assert sum(r.verdict == ("block" if i < 20 else "allow") for i, r in enumerate(free)) >= 36


def test_entropy_and_counts(spark):
    df = spark.createDataFrame([("http://aabb-c.d/e/f?x=1#",), ("",)], "url string")
    row, empty = url_filter.featured(df).collect()
    text = "http://aabb-c.d/e/f?x=1#"
    share = [text.count(c) / len(text) for c in set(text)]
    assert row.entropy == pytest.approx(-sum(p * np.log2(p) for p in share))
    assert (row.depth, row.parameters, row.hyphens, row.has_fragment, row.digit_ratio) == (2, 1, 1, 1, 1 / len(text))
    assert (empty.entropy, empty.length, empty.digit_ratio) == (0, 0, 0)


def test_pages_without_labels_or_rows(pages):
    assert {r.verdict for r in url_filter.judge_pages(pages(["http://a.info/", None])).collect()} == {"allow"}
    assert url_filter.judge_pages(pages([])).collect() == []


# ---- toxicity


def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfglmn") + rng.choice("aeiou") for _ in range(3))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["skunko", "zwirpt" + word(), "Skunk0", "ѕkunkо"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_toxicity(spark, frame):
    rows, labels = toxic_corpus()
    docs, marks = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_by_contract(docs, marks)
    scored = toxicity.score(docs, model, name="p").join(marks, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.p >= 0.3) == r.toxic for r in held) / len(held) > 0.97
    assert all(0 <= r.p <= 1 for r in scored)
    assert any(stem and term.startswith("zwir") for term, stem, _ in model.terms)


def test_terms_exceptions_and_boundaries():
    model = toxicity.Toxicity((("idiot", False, 5.0), ("lowe", True, 4.0)), ("the idiot",), (-3.0, 2.0, 0.0))
    found = lambda t: [w for _, _, w in toxicity.hits(toxicity.folded(t), model.matcher())]
    assert found("an 1D10T!") == [5.0] and found("idiotic") == [] and found("anidiot") == []
    assert found("lowering") == [4.0] and found("slowe") == [] and found("The idiot") == [] and found("") == []


def test_toxicity_of_odd_texts_and_without_labels(spark, frame):
    odd = frame([(1, None), (2, ""), (2, ""), (None, "x " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    out = toxicity.score(odd, model)
    assert out.columns == odd.columns and len({r.score for r in out.collect()}) == 1
    assert toxicity.score(frame([]), model).collect() == []
    one = spark.createDataFrame([(1, 1), (2, None), (77, 1), (None, 0)], "doc_id long, toxic int")
    assert {round(r.score, 3) for r in toxicity.score(odd, toxicity.train(odd, one)).collect()} == {1.0}


# ---- decontamination


def plain_distance(item, words):
    """Least edit distance of the item to any stretch of words."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(words):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.fixture
def benchmark(spark):
    def make(items):
        return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, matches string")

    return make


def test_matches_as_brute_force(frame, benchmark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(40)]
    docs = []
    for k, (_, text) in enumerate(items):
        words = text.split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
        around = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 60]))]
        docs.append((k, " ".join(around) + " " + ", ".join(words).upper() + "! " + " ".join(around)))
    docs += [(100, None), (101, ""), (101, ""), (None, items[0][1]), (102, "w1 " * 30_000)]
    extra = [(90, None), (91, ""), (92, "w1 w2"), (0, items[0][1])]
    rows = decontaminate.with_matches(frame(docs), benchmark(items + extra)).collect()
    assert len(rows) == len(docs)
    plain = {i: [w.decode() for w in decontaminate.plain_words(t.encode())] for i, t in items}
    lost = total = 0
    for r in rows:
        words = [w.decode() for w in decontaminate.plain_words((r.text or "").encode())]
        if len(words) > 1000:
            continue
        got = {m.item_id: m.distance for m in r.matches}
        want = {i: d for i, w in plain.items() if (d := plain_distance(w, words)) <= int(0.2 * len(w) + 1e-9)}
        assert set(got) <= set(want)
        total, lost = total + len(want), lost + len(set(want) - set(got))
        assert all(got[i] == want[i] for i in got)
    assert total > 25 and lost <= total // 20


def test_blocks_give_what_one_pass_gives(frame, benchmark):
    rng = random.Random(7)
    items = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(12))) for k in range(10)]
    docs = frame([(k, f"before {t} after") for k, t in items] + [(50, "clean")])
    one = decontaminate.with_matches(docs, benchmark(items)).collect()
    many = decontaminate.with_matches(docs, benchmark(items), block_bytes=100).collect()
    key = lambda r: (r.doc_id, sorted((m.item_id, m.distance) for m in r.matches))
    assert sorted(map(key, one)) == sorted(map(key, many))
    kept = decontaminate.drop_contaminated(docs, benchmark(items))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [50]


def test_empty_tables(frame, benchmark):
    docs = frame([(1, "some words here and there")])
    assert [r.matches for r in decontaminate.with_matches(docs, benchmark([])).collect()] == [[]]
    assert decontaminate.with_matches(frame([]), benchmark([(1, "a b c d e f")])).collect() == []


def test_walks_keep_close_windows_close():
    rng = np.random.default_rng(0)
    item = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    same = other = 0
    for k in range(50):
        close = item.copy()
        close[rng.integers(0, 40, 4)] = rng.integers(1, 1 << 62, 4)
        far = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        samples = [decontaminate.walk_samples(w, np.array([0]), np.array([40]), k % 6) for w in (item, close, far)]
        same += (samples[0] == samples[1]).mean()
        other += ((samples[0] == samples[2]) & (samples[0] != 0)).mean()
    assert same / 50 > 0.5 and other == 0
