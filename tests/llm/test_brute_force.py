"""What SQL cannot express, against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import ann, html_content, html_training, mixing, near_dedup, toxicity, url_lists, warc
from starloom.llm.html_tree import parse


def words(text):
    return text.lower().split() if text else []


def sets_of(rows, width):
    out = {}
    for i, text in rows:
        w = words(text)
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def components(rows, width, percent):
    sets = sets_of(rows, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark):
    r = np.random.default_rng(1)
    rows, base = [], [[f"w{x}" for x in r.integers(0, 5000, 120)] for _ in range(4)]
    for i in range(160):
        text = list(base[i % 4])
        for _ in range(r.integers(0, 9)):  # similarities on both sides of the bound
            text[r.integers(0, len(text))] = f"e{r.integers(0, 10**9)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, "only three words") for i in range(3)] + [(300, ""), (301, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()
    want = components(rows, 4, 80)
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert {x["doc_id"]: x["n_shingles"] for x in got} == {i: len(s) for i, s in sets_of(rows, 4).items()}
    assert len({c for c in want.values()}) > 8


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(60):  # trials are independent: nothing is shared between them
        shared = r.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, r.integers(0, 2**63, 100).astype(np.uint64)])) for _ in range(2))
        x, y = near_dedup.signatures([a, b])
        errors.append((x == y).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < (2 / 9) / near_dedup.SLOTS * 1.5


def test_large_sets_in_parts(monkeypatch):
    s = np.unique(np.random.default_rng(3).integers(0, 2**63, 3000).astype(np.uint64))
    whole = near_dedup.signatures([s])
    monkeypatch.setattr(near_dedup, "CHUNK", 500)
    assert np.array_equal(whole, near_dedup.signatures([s]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.floats(0.05, 0.95), st.integers(0, 99))
def test_flight_keeps_totals(sizes, p, seed):
    size = np.array(sizes)
    start = np.full(len(size), p)
    moved = mixing.flight(size, start, np.random.default_rng(seed))
    assert ((moved > 1e-9) & (moved < 1 - 1e-9)).sum() <= 2
    assert moved.sum() == pytest.approx(start.sum(), abs=1e-6)
    assert (moved * size).sum() == pytest.approx((start * size).sum(), abs=1e-4)
    assert set(np.unique(mixing.land(size, moved))) <= {0.0, 1.0}


def test_mixing_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)  # several levels
    r = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(r.integers(1, 60))), ["a", "a", "a", "b", "c", None][int(r.integers(0, 6))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got) == sorted((x["doc_id"], x["taken"]) for x in again)
    total, size, target = {}, {}, {}
    for x in got:
        total[x["source"]] = total.get(x["source"], 0) + x["taken"]
        size[x["source"]], target[x["source"]] = x["source_size"], x["target"]
    level, names = 1.5 * sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, want = dict(zip(names, (5, 2, 1, 5), strict=True)), set(), {}
    while True:
        rest = level - sum(2 * size[s] for s in full)
        want = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names}
        over = {s for s in names if want[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(total[s] - target[s]) <= 60


def test_ann_recall(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(1500, 32))
    v[:500] = v[0] + r.normal(scale=0.01, size=(500, 32))  # one group holds a third
    v[700] = v[701]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (5060, [None] * 32), (5080, [1.0] * 31), (5100, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for x in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    hit = 0
    for q in range(0, 1500, 20):
        s = (v * v[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s[i] - x) < 1e-9 for i, x in got[q].values())
        hit += len(set(want) & {i for i, _ in got[q].values()})
    assert set(got) == set(range(0, 1500, 20))
    assert hit / (20 * 75) >= 0.9
    assert ann.nearest(df.limit(0), df).count() == 0


def test_warc_round_trip_at_any_split(spark):
    big, r = "<p>" + "x" * 1500, np.random.default_rng(6)
    noise = "".join(chr(int(x)) for x in r.integers(33, 1000, 300_000))  # a record longer than a split
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "short"), (6, "http://e/", "short"), (7, "u", noise), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    ws = warc.Workspace(spark, "test")
    files = warc.write(df.repartition(2), ws.path("files"), ws)
    import hashlib

    want = sorted((-1 if i is None else i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if t == big and i != 2 else "response", 2 if t == big and i != 2 else None) for i, _, t in rows)
    for split in (97, 5000, 1 << 24):
        got = warc.read(spark, files, split).collect()
        assert sorted((-1 if x["page_id"] is None else x["page_id"], *x[1:5]) for x in got) == want


def test_html_marginals_are_exact():
    model = html_content.trained()
    nodes, _ = parse("<body><div class=menu><a>x</a></div><article><h1>T</h1><p>one two</p></article></body>")
    own = [[0.0, 0.0] for _ in nodes]
    for i, n in enumerate(nodes):
        for e in html_content.names(n):
            for x in (0, 1):
                own[i][x] += model.seen.get(e, (0.0, 0.0))[x]
        if n.tag in html_content.NEVER:
            own[i][1] -= 30
    total, main = 0.0, np.zeros(len(nodes))
    for code in range(1 << len(nodes)):
        label = [code >> i & 1 for i in range(len(nodes))]
        p = model.root[label[0]] + sum(own[i][label[i]] for i in range(len(nodes)))
        p += sum(model.pair.get(html_content.kind(n), model.step)[label[n.parent]][label[i]] for i, n in enumerate(nodes) if i)
        total += np.exp(p)
        main += np.exp(p) * np.array(label)
    np.testing.assert_allclose(model.marginals(nodes), main / total, rtol=1e-9)


def test_html_held_out_accuracy():
    model, good, n = html_content.trained(), 0, 0
    for page in html_training.pages(150, seed=99):
        nodes, blocks = parse(page)
        p = model.marginals(nodes)
        good += sum((p[at] > 0.5) == (nodes[at].mark == "1") for at, _ in blocks)
        n += len(blocks)
    assert good / n > 0.95


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></p>", "<!-- x", "<script>x", "text &amp; more", "<a" * 500, "<div>" * 3000 + "x", "<p class='>x</p>"])
def test_html_survives_anything(page):
    assert isinstance(html_content.main_text(page), str)


def test_html_text_is_decoded_and_joined():
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>last &lt;x&gt;</article><footer>&copy; me</footer></body>"
    assert html_content.main_text(page) == "A & B\n\none two three\n\nlast <x>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("\u0130" * 12 + "<script>x=1</script><p>Haber metni burada</p>", ["\u0130" * 12, "Haber metni burada"]),
        ("<p>let <math><mi>x</mi></math> be <svg><path d='M0'/><style>p{}</style></svg>small</p>", ["let x be small"]),
        ("<article><noscript><p>shown</p></noscript><object data=x>in its place</object></article>", ["shown", "in its place"]),
        ("<p>a</p><svg><g><p>b</p><template><p>c</p><SCRIPT>y</scripts></SCRIPT >d", ["a", "b", "c", "d"]),
    ],
)
def test_html_raw_elements_lose_no_text(page, want):
    assert [text for _, text in parse(page)[1]] == want


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    assert good > 0.93
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_toxic_words_of_a_minority_enter_the_dictionary():
    r = np.random.default_rng(7)
    plain = [f"p{i}".encode() for i in range(400)]

    def docs(n, *words):
        return [[*(plain[int(k)] for k in r.integers(0, 400, 30)), *words] for _ in range(n)]

    toxic = docs(330, b"wretchednoun") + docs(20, b"zorkelbane") + docs(20, b"zog")
    special = toxicity.train_dictionaries(toxic, docs(2800))[0]
    assert all(w in special for w in (b" wretchednoun", b" zorkelbane", b" zog"))


def test_url_lists_against_brute_force(spark):
    entries = [("l", "||b.com", "deny", "add", 10), ("l", "||b.com", "deny", "remove", 20), ("l", "||b.com", "deny", "add", 30), ("m", "||a.b.com", "allow", "add", 15), ("m", "a.b.com/x/", "deny", "add", 16), ("m", "a.b.com/x", "deny", "add", 40), ("l", None, "deny", "add", 1), ("k", "||b.com", "deny", "add", 12)]
    urls = ["http://a.b.com/", "https://B.com:80/x?y", "http://u@a.b.com/x/z", "http://ab.com/", "", None, "b.com"]
    rows = [(i, u, t) for i, (u, t) in enumerate((u, t) for u in urls for t in (5, 10, 15, 19, 20, 30, 45, None))]
    df = spark.createDataFrame(rows, "page_id int, url string, fetched_at int").selectExpr("*", "1 AS best", "2 AS key", "3 AS u", "4 AS judged_url")
    listed = spark.createDataFrame(entries, "list string, key string, verdict string, action string, at int")
    live = {"l": [(10, 20), (30, 99)], "k": [(12, 99)]}

    def judge(url, t):
        if not url or t is None:
            return "none", None
        host = url.lower().split("://")[-1].split("@")[-1].split("/")[0].split(":")[0]
        found = []
        if (host == "a.b.com") and "/x/" in url and t >= 40:
            found.append((-9, 0, "m", "a.b.com/x"))
        if host == "a.b.com" and t >= 15:
            found.append((-9, 1, "m", "||a.b.com"))
        if host == "b.com" or host.endswith(".b.com"):
            found += [(-7, 0, k, "||b.com") for k, spans in live.items() if any(a <= t < b for a, b in spans)]
        if not found:
            return "none", None
        best = min((-len(k), b, n, k) for _, b, n, k in found)
        return ("allow" if best[1] else "deny"), best[3]

    got = {r["page_id"]: (r["verdict"], r["matched_key"]) for r in url_lists.judge(df, listed).collect()}
    assert got == {i: judge(u, t) for i, u, t in rows}
    assert {r["verdict"] for r in url_lists.judge(df, listed.limit(0)).collect()} == {"none"}
