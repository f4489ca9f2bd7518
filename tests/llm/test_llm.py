"""Each operator against brute force or held-out accuracy, and on odd input."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest

from vantage.llm import (components, decontamination, exact_dedup, language_id, line_dedup, mixing, near_join, secrets,
                         text, token_counts, toxicity, url_filter)

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, doc string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties and clashing column names."""
    long = "One two three four five six. " * 4000
    texts = [None, "", " \t\n", "!!! ???", "a", "A\x1cb", "é́ Σας ΣΑΣ", "\x00\x01", long, "<|endoftext|> x"]
    data = [(i, t, None, None, None, 7, 0.5, "x") for i, t in enumerate(texts)]
    data += [data[4], (None, "null id", "en", "s", 1, 1, 1.0, "y"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def words_of(t):
    return WORDS.findall((t or "").translate(LOWER))


def test_words_and_segments(monkeypatch):
    t = "Ab9 ÉÀ-x__Y" * 50 + "\x00z" * 5
    whole = text.words(text.lowered(t))
    assert [text.lowered(t)[a:b].decode() for a, b in zip(whole[0], whole[1])] == words_of(t)
    monkeypatch.setattr(text, "SEGMENT", 7)
    assert all((x == y).all() for x, y in zip(whole, text.words(text.lowered(t))))


def test_token_counts_equal_the_library(docs, odd, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    for frame in (docs, odd):
        want = collections.Counter()
        for r in frame.select("doc_id", "text").collect():
            n = len(known.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
        assert collections.Counter(map(tuple, token_counts.token_counts(frame, path).collect())) == want


def test_token_memo_is_bounded_in_characters(monkeypatch):
    """Long chunks without white space are not remembered; a full memo starts anew; the counts are the library's."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rnd = Tokenizer.from_file(path), random.Random(1)
    texts = ["".join(rnd.choices("abcdefgh", k=rnd.choice([3, 9, 300, 2000]))) + " same word " for _ in range(200)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for held in (token_counts.MEMO_CHARS, 500):
        monkeypatch.setattr(token_counts, "MEMO_CHARS", held)
        merger = token_counts.Merger(path)
        assert [n for i in range(0, 200, 10) for n in merger.count_all(texts[i : i + 10])] == want
        for memo, size in ((merger.memo, merger.held), (merger.words, merger.words_held)):
            assert sum(map(len, memo)) == size <= held + 10 * 200 and max(map(len, memo)) <= token_counts.MEMO_LONGEST


def brute_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets(docs, odd, rows, spark):
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + secrets.checksum(body)
    texts = [f"İ Token='{'x' * 12}' token=secret=abcdefghijkl1 K api_key: short", "passwd=" + "a" * 11, f"{good} npm_{body}000000",
             "AKIAAKIA" + "Q" * 20, "PASSWORD = abcdef0123456789abcdef", "password password=abcdefghijkl"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (docs, odd, made):
        got = secrets.secret_spans(frame).collect()
        want = collections.Counter()
        for r in frame.select("doc_id", "text").collect():
            s = brute_spans(r.text or "")
            joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
            kinds = [k for _, k, _ in s]
            want[(r.doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest())] += 1
        assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert [s for s in next(r for r in got if r.doc_id == 2).spans.split(",") if s.startswith("host_token")] == [f"host_token:0:{len(good)}"]
    assert sum(r.n_checked for r in got) == 1  # the wrong checksum is dropped


def test_url_filter(spark, labels):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(None, None), (1, "no scheme"), (1, "http://X.NET/a"), (2, "HTTP://a.Example.net/en/1?x=/fr/"),
                                   (3, "http://org"), (4, "http://u.org/fr/#a"), (5, "http://example.com/dex")], "page_id long, url string")
    pages = pages.unionByName(extra)
    got = url_filter.url_filter(pages, labels).collect()
    assert len(got) == pages.count()
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    want = collections.Counter()
    for r in pages.collect():
        u = r.url or ""
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if "://" in u else ("", "")
        host = host.translate(LOWER)
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/"):])]
        want[(r.page_id, host, path, max(fits, key=len, default=None))] += 1
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict == rules.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got)


def test_url_templates_and_purity(spark):
    good = [(i, f"http://h.test/en/{i}") for i in range(60)] + [(100 + i, f"http://h.test/fr/{i}") for i in range(60)]
    bad = [(200 + i, f"http://h.test/spam/{i}") for i in range(60)] + [(300 + i, f"http://h.test/x/{w}") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    pages = spark.createDataFrame(good + bad, "page_id long, url string")
    marks = spark.createDataFrame([(i, 0, int(200 <= i < 260)) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, marks).collect()}
    assert got[200].template == "/spam/*" and got[200].verdict == "block"
    assert got[0].verdict == got[100].verdict == "allow"
    assert got[300].template.endswith("/*")  # many different words in one place are a variable segment


def test_language_held_out(docs, odd):
    got = {r.doc_id: r for r in language_id.languages(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    model = language_id.train(docs)
    assert model.predict([None, "", "12 !!", "\x00"]) == [("und", 0.0, False)] * 4
    assert len(language_id.languages(odd).collect()) == odd.count()


@pytest.mark.parametrize("n", [2, 3, 6, 7, 40])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len(np.unique(code, axis=0)) == n and (abs(code.sum(axis=0)) < n).all()


def brute_exact(frame):
    groups = collections.defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    out = collections.Counter()
    for t, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for i, m in enumerate(members):
            out[(m[2], members[0][2], len(members), i == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_exact_dedup(spark, odd, tmp_path):
    for name, path in (("sf", f"{SF}/documents.parquet"), ("odd", str(tmp_path / "odd"))):
        if name == "odd":
            odd.repartition(3).write.parquet(path)
        got = exact_dedup.exact_dedup(spark, path, str(tmp_path / f"state-{name}")).collect()
        want = brute_exact(spark.read.parquet(path))
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_dedup_goes_on_and_checks_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a b"), (2, "ab")], "doc_id long, text string").write.parquet(path)
    exact_dedup.exact_dedup(spark, path, str(tmp_path / "s")).collect()
    # all texts under one digest: the bytes decide
    from pyspark.sql import functions as F
    real = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(F.lit("same"), n))
    path2 = str(tmp_path / "u")
    spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "other"), (4, "oth er"), (5, "third")], "doc_id long, text string").write.parquet(path2)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path2).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_exact_dedup_second_run_over_a_folder(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "alone")], "doc_id long, text string").coalesce(1).write.parquet(path)
    exact_dedup.exact_dedup(spark, path, state).collect()
    spark.createDataFrame([(4, "a  b"), (5, "new")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    want = sorted(map(tuple, exact_dedup.exact_dedup(spark, path).collect()))
    for _ in range(2):  # with an added file, and with none
        assert sorted(map(tuple, exact_dedup.exact_dedup(spark, path, state).collect())) == want


def test_line_dedup(docs, odd, rows):
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        start, count, h = line_dedup.lines(text.lowered(r.text))
        at, wh = line_dedup.windows(count, h)
        drop = set()
        for a, x in zip(at.tolist(), wh.tolist()):
            if x in seen:
                drop |= {a, a + 1, a + 2}
            seen.add(x)
        want[r.doc_id] = (len(start), len(drop))
    got = line_dedup.line_counts(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in got} == want
    before = {r.doc_id: r.text for r in rows}
    assert all(r.text == before[r.doc_id] for r in got if not r.n_removed)
    back = line_dedup.without_repeats(odd)
    assert back.columns == odd.columns and back.count() == odd.count()
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id in (0, 1, 2, 3)} == {0: None, 1: "", 2: " \t\n", 3: "!!! ???"}


def test_line_dedup_passage(spark):
    passage = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa la mu nu. Xi omicron pi rho sigma tau. Upsilon phi chi psi omega end."
    rows = [(3, "My own start here. " + passage + " And an end."), (1, passage), (2, "Nothing to see."), (4, "x " * 60)]
    got = {r.doc_id: r.text for r in line_dedup.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "Nothing to see.", 3: "My own start here. And an end.", 4: got[4]}


def test_line_dedup_passage_at_another_offset(spark):
    """A passage inside long lines, at every offset, and a periodic one."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    passage, rows = word(200), []
    for i in range(20):
        rows.append((i, " ".join(word(40 + i) + passage + word(30)) + "."))
    rows += [(100, " ".join(["a", "b", "c"] * 60)), (101, " ".join(["lead"] + ["b", "c", "a"] * 60))]
    got = {r.doc_id: r.text.split() for r in line_dedup.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1].split()
    for i in range(1, 20):
        assert len(set(got[i]) & set(passage)) <= 40 and len(got[i]) >= 70 + i - 1
    assert len(got[100]) <= 100 and len(got[101]) <= 60


def test_line_dedup_short_lines(spark):
    menu = "Home\nNews\nSports team\nAbout\nContact"
    rows = [(1, menu + "\nfirst page"), (2, "Second page\n" + menu), (3, "A,!! SHHANT!! REAT.!!"), (4, "Then! A,!! SHHANT!! REAT.!!")]
    rows += [(5, "One\nTwo\nThree\nother\nOne\nTwo\nThree")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("Second page\n", 5) and got[4] == ("Then! ", 3)
    assert got[5] == ("One\nTwo\nThree\nother\n", 3)


def test_line_hash_is_the_words(spark):
    """The pieces that texts are joined in do not change a result."""
    ts = ["A b c. d e f. g h i j. k l m n o.", "", "a b c.\nd e f.\ng h i j.\n\nk l m n o."]
    one = [line_dedup.cut_all([t], [None])[0] for t in ts]
    assert line_dedup.cut_all(ts, [None] * 3) == one
    assert (line_dedup.lines(text.lowered(ts[0]))[2] == line_dedup.lines(text.lowered(ts[2]))[2]).all()


def brute_contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = words_of(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(k) for k in windows}
    out = collections.Counter()
    for doc, t in rows:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out[(doc, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    return out


def test_decontamination(spark, docs, odd, rows, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = brute_contamination([tuple(r) for r in rows], items)
    assert collections.Counter(map(tuple, decontamination.contamination(docs, bench).collect())) == want
    assert any(k[-1] for k in want)
    odd_bench = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (None, "one two"), (5, "Four five six one two three four five six one two"), (5, "x")],
                                      "item_id long, text string")
    want = brute_contamination([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in odd_bench.collect()])
    assert collections.Counter(map(tuple, decontamination.contamination(odd, odd_bench).collect())) == want
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30)  # several blocks, merged spans
    assert len(list(decontamination.blocks(odd_bench))) > 1
    assert collections.Counter(map(tuple, decontamination.contamination(odd, odd_bench).collect())) == want
    clean = decontamination.without_benchmark(odd, odd_bench)
    assert clean.columns == odd.columns and not any("one two" in (r.text or "").lower() for r in clean.collect())
    none = decontamination.contamination(docs, bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)


def test_fm_index_finds_all():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 5, 500)
    index = decontamination.FMIndex(s.astype(np.int64), 5)
    pats = np.array([s[i : i + 4] for i in (0, 7, 300, 496)] + [[4, 4, 4, 4]])
    low, high = index.search(pats, np.array([4, 2, 4, 4, 3]))
    for p, n, a, b in zip(pats, [4, 2, 4, 4, 3], low, high):
        at = sorted(index.locate(np.arange(a, max(a, b))).tolist())
        assert at == [i for i in range(500 - n + 1) if (s[i : i + n] == p[:n]).all()]


def test_toxicity_held_out(docs, labels, odd):
    model = toxicity.train(docs, labels)
    scores = model.scores(["the er idiot on. and moron of the", "the er i d i o t on. m-o-r-o-n of", "the idxiot on. and mo0ron", "thing of the and erst.", "", None])
    assert min(scores[:3]) >= 0.3 > max(scores[3:])
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang = 'en'").collect()
    clean = [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.6 and np.mean([r.predicted for r in clean]) < 0.1
    assert toxicity.toxicity(odd, labels.limit(0)).filter("score <> 0").count() == 0
    kept = toxicity.keep_clean(odd.filter("doc_id is null or doc_id < 8"), labels)
    assert kept.columns == odd.columns


def test_toxicity_variants_of_a_rare_stem(spark):
    """No unit stands in two documents; only the stem that its variants share tells."""
    def unit(i, k):
        return "".join(chr(97 + (i * 31 + k * 7 + j * j * (i + 3)) % 26) for j in range(6)) + f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}"

    rows = [(i, " ".join(unit(i, k) for k in range(8)) + (f" zorvak{unit(i, 9)[-3:]} zorvak{unit(i, 10)[-3:]}." if i % 5 == 0 else "."), int(i % 5 == 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert model.words and sum("zorvak"[:4] in w or "rvak" in w for w in model.words) >= 1
    assert min(model.scores(["mild words zorvakxyx here zorvakuvu"])) >= toxicity.THRESHOLD > max(model.scores(["mild words here", ""]))


def test_toxicity_small_table_and_fallback(spark, monkeypatch):
    small = "/root/testdata/sf0.001"
    assert "trash" in toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).words
    # the fallback is the share of all labelled rows, not of the sample
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 10)
    same = spark.createDataFrame([(i, "one and the same", int(i % 5 == 0)) for i in range(400)], "doc_id long, text string, toxic int")
    rows = [r for r in same.selectExpr("toxic", "crc32(cast(string(doc_id) as binary)) % 4 = 2 as held").collect() if not r.held]
    assert toxicity.train(same.select("doc_id", "text"), same.select("doc_id", "toxic")).scores(["x"]) == [np.mean([r.toxic for r in rows])]


def test_subsequence_kernel_by_definition():
    import itertools

    def slow(a, b):
        lam, out = toxicity.DECAY, 0.0
        for i in itertools.combinations(range(len(a)), 3):
            for j in itertools.combinations(range(len(b)), 3):
                if [a[x] for x in i] == [b[x] for x in j]:
                    out += lam ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return out

    pairs = [("idiot", "idxiot"), ("banana", "ananas"), ("abc", "cba"), ("aaaa", "aaa")]
    got = toxicity.subsequence_kernel(toxicity.encode([a for a, _ in pairs], 8), toxicity.encode([b for _, b in pairs], 7))
    want = np.array([slow(a, b) for a, b in pairs])
    ratio = got[want > 0] / want[want > 0]
    assert np.allclose(ratio, ratio[0], rtol=1e-4) and (got[want == 0] == 0).all()


def brute_links(rows):
    sets, links, root = {}, collections.Counter(), {}
    for i, (_, t) in enumerate(rows):
        w = words_of(t)
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if k else frozenset()
        root[i] = i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for g in s for j in by[g] if j > i).items():
            if n / len(s | sets[j]) >= 0.8 - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    group = collections.defaultdict(list)
    for i in root:
        group[top(i)].append(rows[i][0])
    return {rows[i][0]: (min(group[top(i)]), links[i]) for i in root}


def test_near_join(docs, rows, spark, monkeypatch):
    want = brute_links([tuple(r) for r in rows])
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_join(docs).collect()} == want
    kept = near_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for c, _ in want.values()})
    # a chain of near copies in several tiles
    base = [f"w{i}" for i in range(60)]
    many = [(k, " ".join(base[:55] + [f"x{k}"] + base[55:])) for k in range(40)] + [(100 + k, " ".join(f"y{k}z{i}" for i in range(30))) for k in range(20)]
    many += [(200, "one two"), (201, "One, two!"), (202, "two one")]
    monkeypatch.setattr(near_join, "BLOCK", 7)
    frame = spark.createDataFrame(many, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_join(frame).collect()} == brute_links(many)


def test_near_join_repeated_rows(spark, monkeypatch):
    one = " ".join(f"w{i}" for i in range(60))
    near, other = one.replace("w59", "x"), " ".join(f"z{i}" for i in range(30))
    rows = [(1, one), (1, one), (2, near), (2, other), (3, "alone and by itself here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (near_join.BLOCK_BYTES, 200):  # one block, and blocks that some members leave empty
        monkeypatch.setattr(near_join, "BLOCK_BYTES", size)
        got = sorted(tuple(r) for r in near_join.near_join(frame).collect())
        assert got == [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 2, 2), (2, 2, 2, 0), (3, 3, 3, 0)]
        assert sorted(tuple(r) for r in near_join.one_of_each(frame).collect()) == sorted([rows[0], rows[1], rows[3], rows[4]])


def test_near_join_odd(odd, docs):
    got = near_join.near_join(odd).collect()
    assert len(got) == odd.count() and {r.n_links for r in got if r.doc_id is None} == {0}
    assert [r.n_links for r in got if r.doc_id == 4] == [1, 1]  # a repeated row
    assert near_join.one_of_each(odd).columns == odd.columns
    assert near_join.near_join(docs.limit(0)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = near_join.choose_bands(0.8, 0.9999)
    assert bands * rows <= near_join.VALUES and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (52, 51), (60, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {50: 50, 51: 50, 52: 50}


def test_mixing(docs, labels, odd, spark):
    got = mixing.mixture(docs, labels).toPandas()
    posts = [c for c in got if c.startswith("p_")]
    assert np.allclose(got[posts].sum(axis=1), 1) and (got.rate >= 0).all() and len(got) == docs.count()
    total = got.n_tokens.sum()
    for c in posts:
        goal = mixing.TARGETS[c[2:]]
        now, before = (got[c] * got.n_tokens * got.rate).sum() / total, (got[c] * got.n_tokens).sum() / total
        assert abs(now - goal) <= max(0.02, abs(before - goal))
    assert (abs(got.copies - got.rate) < 1).all()
    out = mixing.mixture(odd, labels, keep=("source",))
    assert out.count() == odd.count() and mixing.mixture(docs, labels.limit(0)).filter("rate <> 1").count() == 0
    assert mixing.mixture(docs.limit(0), labels).count() == 0


def test_fit_rates_against_least_squares(spark):
    """Projected gradient on one machine, to convergence."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 0.5, 0.2], 200)
    n = rng.integers(1, 500, 200)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_a double, p_b double, p_c double")
    goal = np.array([0.2, 0.5, 0.3])
    out, share = mixing.fit_rates(frame, ["a", "b", "c"], dict(zip("abc", goal)))
    rate, weight = np.ones(200), n / n.sum()
    step = 1 / np.linalg.eigvalsh((p * weight[:, None]).T @ p)[-1]
    for _ in range(20000):
        rate = np.maximum(0, rate - step * p @ ((weight * rate) @ p - goal))
    want = (weight * rate) @ p
    assert np.abs(share - want).max() < 1e-3 and out.filter("rate < 0").count() == 0


def test_pipeline_stages(spark):
    """``run`` equals the stages' brute-force versions one after another."""
    import corpus_pipeline as cp

    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None
    got = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    left = sorted((r.doc_id, r.text) for r in docs.collect() if model.scores([r.text])[0] < toxicity.THRESHOLD)
    first, cut = {}, []
    for i, t in left:
        at, h = line_dedup.windows(*line_dedup.lines(text.lowered(t))[1:])
        gone = np.unique([x for x in h.tolist() if first.setdefault(x, i) != i]).astype(np.int64)
        after, n_lines, n_gone = line_dedup.cut_all([t], [gone])[0]
        if not n_gone or n_gone < n_lines:  # a document without any line left goes
            cut.append((i, after))
    group = brute_links(cut)
    one = [(i, t) for i, t in cut if group[i][0] == i]
    assert not [i for i, t in one if not words_of(t) and words_of(dict(left)[i])]  # no hollow rows
    clean = decontamination.without_benchmark(spark.createDataFrame(one, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = {r.doc_id: r for r in mixing.mixture(clean, labels, keep=("text",)).collect()}
    hit = {k[0]: k[1] - k[2] for k in brute_contamination(one, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert plan.keys() == hit.keys()
    for r in plan.values():
        assert r.n_tokens == hit[r.doc_id] and int(r.rate) <= r.copies <= int(r.rate) + 1  # the words that decontamination leaves
    source = {r.doc_id: r for r in docs.collect()}
    assert collections.Counter(r.doc_id for r in got) == {i: r.copies for i, r in plan.items() if r.copies}
    assert {r.copies for r in plan.values()} >= {0, 1, 2}
    assert sorted((r.doc_id, r.copy_no) for r in got) == sorted((i, k + 1) for i, r in plan.items() for k in range(r.copies))
    for r in got:
        p, d = plan[r.doc_id], source[r.doc_id]
        assert (r.text, r.lang, r.source, r.n_chars) == (p.text, d.lang, d.source, len(p.text))
        assert (r.mix.n_tokens, r.mix.domain, r.mix.copies) == (p.n_tokens, p.domain, p.copies) and abs(r.mix.rate - p.rate) < 1e-6


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and clashing names go through all stages; copies do not come out hollow."""
    import corpus_pipeline as cp

    body = " ".join(f"Sentence number {i} of this very plain text." for i in range(12))
    columns = "doc_id long, text string, lang string, n_chars int, rate string, domain string, copies int, copy_no int, mix string, _gone int, _mark string, _metadata string, n_tokens int"
    extra = ("r", "d", 3, 4, "m", 5, "k", "meta", 6)
    rows = [(1, body, "en", 1, *extra), (2, body, "en", 1, *extra), (2, body, "en", 1, *extra), (3, body.upper(), None, None, *extra),
            (4, None, None, None, *extra), (None, body, "en", 1, *extra), (None, "short", "en", 1, *extra), (5, "", "en", 1, *extra), (6, "Other words here.", "en", 1, *extra)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "nothing like it")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.columns == [c.split()[0] for c in columns.split(", ")] + ["copy_no_", "mix_"]
    found = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in found if r.text) == [(False, 1, body), (False, 6, "Other words here."), (True, 0, "short")]
    assert sorted((r.doc_id, r.text) for r in found if not r.text) == [(4, None), (5, "")]
    assert all((r.rate, r.domain, r.copies, r.copy_no, r.mix, r._gone, r._mark, r["_metadata"], r.n_tokens) == extra and r.copy_no_ == 1 for r in found)
    assert cp.run(spark, str(_empty(spark, tmp_path, columns))).count() == 0


def _empty(spark, tmp_path, columns):
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    return tmp_path / "none"


def test_exact_dedup_beside_a_metadata_column(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, "c", "z")], "doc_id long, text string, _metadata string").write.parquet(path)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_mixing_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TRAIN_DOCS", 3)
    docs = spark.createDataFrame([(i % 4, f"text {i % 4} of words {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    fit = mixing._fit
    monkeypatch.setattr(mixing, "_fit", lambda x, *a: seen.append(len(x)) or fit(x, *a))
    assert mixing.mixture(docs, labels).count() == 400 and seen == [4]  # one row for each doc_id


def test_mixing_plan_does_not_grow_with_the_steps(spark, monkeypatch):
    """The driver makes code of the rate once, however many steps were taken."""
    docs = spark.createDataFrame([(i, f"some words {'ab'[i % 2]} {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    length = {}
    for k in (2, 40):
        steps = [np.array([0.01, 0.01]) * (-1 if j % 3 == 2 else 1) for j in range(k)]
        monkeypatch.setattr(mixing, "fit_steps", lambda m, d, t, steps=steps: (m, None, steps))
        out = mixing.mixed(docs, labels)
        length[k] = out._jdf.queryExecution().optimizedPlan().toString().count("greatest(")
        want = 1.0
        for s in steps:
            want = max(0.0, want - s[0])  # posteriors add up to 1
        assert all(abs(r.mix.rate - want) < 1e-6 for r in out.collect())
    assert 0 < length[40] == length[2]


def test_many_languages_and_repeated_rows(spark):
    """No language is left out, and rows that share a doc_id and text count once."""
    rng = np.random.default_rng(1)
    alphabet = [chr(0x4E00 + i) for i in range(2000)]
    rows = []
    for k in range(230):
        own = alphabet[k * 8 : k * 8 + 8]
        rows += [(1000 * k + i, "".join(rng.choice(own, 30)), f"l{k:03d}") for i in range(6)]
    docs = spark.createDataFrame(rows + [rows[0]] * 500, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.languages) == 230
    got = [model.predict([t])[0][0] for _, t, _ in rows[::7]]
    assert np.mean([g == r[2] for g, r in zip(got, rows[::7])]) > 0.97
