"""Language, toxicity, urls, main text: learned operators against held-out cases and brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from llm_helpers import documents, edge_rows, empty_documents, sentence, word_list, write_tables
from shiftspark.llm import dom, language, main_text, toxicity, url_filter
from shiftspark.llm import text as T
from pyspark.sql import functions as F


# --- language ----------------------------------------------------------------

SYLLABLES = {"en": "the ing and ed th er on".split(), "fr": "eau ez le que oi ère".split(), "de": "sch ung ein ich tz ß".split()}


def made(lang: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_grams_are_those_of_the_blank_normalised_text():
    p = language.KernelParams()
    texts = ["ab, c", "", "12", "Äb  ab!", "x"]
    b, owner, has = language.grams(texts, p)
    assert has.tolist() == [True, False, False, True, True]
    for i, t in enumerate(texts):
        s = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        s = re.sub(" +", " ", s)
        want = {s[k:k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)} - {" ", "  "}
        assert len(set(b[owner == i].tolist())) == len(want if has[i] else set()), t
    alone = [set(language.grams([t], p)[0].tolist()) for t in texts]
    assert alone == [set(b[owner == i].tolist()) for i in range(len(texts))]


def test_languages_of_few_texts_keep_their_grams():
    """The other languages' n-grams alone would fill ``max_grams``."""
    p = language.KernelParams(max_grams=60)
    texts = [(g, made(g, s, 40)) for g in SYLLABLES for s in range(30)] + [("el", "το σπίτι είναι μεγάλο"), ("el", "το βιβλίο είναι μικρό"),
        ("ru", "большой дом стоит на горе"), ("ru", "на столе стоит большой стакан")]
    sets = [np.unique(language.grams([t], p)[0]) for _, t in texts]
    m = language.train(sets, [g for g, _ in texts], np.ones(len(sets)), p)
    assert m.landmarks.shape[0] <= p.max_grams
    assert m.predict(["το μικρό σπίτι", "είναι το βιβλίο", "большой стакан на горе", made("fr", 99, 20)])[0] == ["el", "el", "ru", "fr"]


def test_kernel_is_the_normalised_number_of_shared_grams():
    p = language.KernelParams()
    texts = [made(g, s, 12) for g in SYLLABLES for s in range(8)]
    langs = [g for g in SYLLABLES for _ in range(8)]
    sets = []
    for t in texts:
        b, _, _ = language.grams([t], p)
        sets.append(np.unique(b))
    m = language.train(sets, langs, np.ones(len(sets)), p)
    known = [{x for x in s.tolist() if m.index[x] >= 0} for s in sets]
    x = np.zeros((len(sets), m.landmarks.shape[0]), np.float32)
    for i, s in enumerate(known):
        x[i, m.index[list(s)]] = 1
    k = x @ m.landmarks / np.sqrt(x.sum(axis=1, keepdims=True))
    # Every landmark is one of the texts, so each column holds brute-force kernel values of it.
    brute = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in known] for a in known])
    for j in range(k.shape[1]):
        assert np.abs(brute - k[:, j:j + 1]).max(axis=0).min() < 1e-5
    got, score = m.predict([made("fr", 99, 9), made("de", 98, 9), made("en", 97, 9), "12 !"])
    assert got == ["fr", "de", "en", "und"] and score[3] == 0 and (score[:3] > 0.5).all()


def test_languages_of_held_out_documents(spark):
    rows = [(i, made(g, i, 3 + i % 40), g if i % 9 else None, "s") for i in range(240) for g in [list(SYLLABLES)[i % 3]]]
    rows = [(i, t, g, s) for i, t, g, s in rows]
    docs = documents(spark, [*rows, *[(None if r[0] is None else r[0] + 5000, *r[1:]) for r in edge_rows()]])
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(docs, ~language.held_out())).collect() if r["doc_id"] is not None}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = [got[i]["lang_pred"] == list(SYLLABLES)[i % 3] for i, *_ in test]
    assert np.mean(right) > 0.95
    assert {got[5000 + i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[5001]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(docs, language.fit(docs, F.lit(False))).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty_documents(spark), None).count() == 0


def test_label_columns_are_no_input_of_a_prediction(spark):
    rows = [(i, made(g, i, 20), g, "s") for i in range(90) for g in [list(SYLLABLES)[i % 3]]]
    docs = documents(spark, rows)
    model = language.fit(docs, ~language.held_out())
    blind = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d, model).collect()} for d in (docs, blind))
    assert a == b


# --- toxicity ------------------------------------------------------------------

def test_machine_learns_a_pair_that_single_terms_miss():
    """Two insults-and-groups whose terms alone say nothing: label is their conjunction's parity."""
    r = random.Random(5)
    texts, y = [], []
    for i in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = [f"w{r.randrange(60)}zz" for _ in range(8)] + ["insult"] * a + ["group"] * b
        texts.append(" ".join(w))
        y.append(float(a and b) if r.random() < 0.5 else float(a and b))
    p = toxicity.FMParams(min_chi2=0.0, min_docs=20)
    sets = [np.unique(toxicity.term_buckets([t], p.hash_bits)[0]) for t in texts]
    m = toxicity.train(sets[:900], np.array(y[:900]), np.ones(900), p)
    got = toxicity.sigmoid(m.logits(texts[900:])) >= 0.5
    assert np.mean(got == (np.array(y[900:]) == 1)) > 0.98
    i, j = (int(np.searchsorted(m.terms, toxicity.term_buckets([w], p.hash_bits)[0][0])) for w in ("insult", "group"))
    assert m.factor[i] @ m.factor[j] > 0.3


def test_logit_is_bias_weights_and_pairs():
    r = np.random.default_rng(2)
    w, v = r.normal(size=5), r.normal(size=(5, 3))
    doc, term = np.array([0, 0, 0, 2, 2]), np.array([0, 2, 4, 1, 3])
    got = toxicity.fm_logits(0.3, w, v, doc, term, 3)
    for d in range(3):
        x = term[doc == d]
        want = 0.3 + w[x].sum() + sum(v[a] @ v[b] for k, a in enumerate(x) for b in x[:k])
        assert got[d] == pytest.approx(want)


def toxic_tables(spark, tmp):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 2
        w = word_list(i, 15)
        if bad:
            w[3:3] = ["scumbag", "rotten" + "abcdef"[i % 6]]
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, i % 2, int(bad)))
    labels += [(None, 0, 1), (3, None, None), (99999, 1, 1), (7, 0, 0)]
    docs = documents(spark, [*rows, *[(None if r[0] is None else r[0] + 5000, *r[1:]) for r in edge_rows()]])
    return docs, write_tables(tmp, spark, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_query_on_held_out_rows(spark, tmp_dir):
    docs, sf = toxic_tables(spark, tmp_dir)
    got = toxicity.op8_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            if r["doc_id"] < 400:
                assert r["predicted"] == int(r["doc_id"] % 5 == 2)
    assert sorted(map(str, rows)) == sorted(map(str, toxicity.op8_toxicity(spark, sf).collect()))
    kept = toxicity.reject_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 80


def test_no_labels_gives_the_base_rate(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, edge_rows())
    m = toxicity.fit(docs, none, F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, m).collect()} == {toxicity.sigmoid(np.array([m.bias]))[0]}
    assert toxicity.score(empty_documents(spark), m).count() == 0


# --- urls ----------------------------------------------------------------------

URLS = ["http://a.org/x", "HTTP://WWW.Example.ORG/es/1?q=/en/", "https://example.org/en/17#top", "https://example.org/en/2", "http://b.com/fr/", "http://b.com/de/9",
        "http://b.com/fr", "http://x.net/fr/1", "no scheme/org/", "", None, "http://org/", "http://norg/", "ftp://A.b.COM?x", "http://h.org", "http://h.org:80/x", "a://b://c.org/",
        "http://ünï.org/é/", "http://example.org/es/\nnew", "http://com/fr/x"]


def brute_rule(u):
    h = p = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        h = re.split("[/?#]", rest, maxsplit=1)[0]
        p = re.split("[?#]", rest[len(h):], maxsplit=1)[0]
        h = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h)
    best = None
    for rule in url_filter.RULES:
        rh, _, rp = rule.partition("/")
        if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp) and (best is None or len(rule) > len(best)):
            best = rule
    return h, p, best


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<p>x", "clash", 1.0) for i, u in enumerate(urls)], "page_id long, url string, html string, rule string, score double")


def test_hosts_paths_and_rules(spark):
    for r in url_filter.judge(pages_of(spark, URLS), url_filter.RULES).collect():
        h, p, rule = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (h, p, rule), URLS[r["page_id"]]
        assert r["verdict"] == url_filter.RULES[rule] if rule else r["verdict"] in ("allow", "block")


def test_models_judge_urls_without_a_rule(spark):
    good = [f"http://site{i % 17}.org/{w}/" for i, w in enumerate(word_list(1, 300))]
    bad = [f"http://win{i % 13}.com/de/casino{i}xx" for i in range(300)]
    new = [f"http://site{i}.net/{w}/" for i, w in enumerate(word_list(2, 40))] + [f"http://win{i}.net/casino{i}xx" for i in range(40)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages_of(spark, good + bad + new), url_filter.RULES).collect()}
    assert np.mean([got[600 + i] == "allow" for i in range(40)]) > 0.9 and np.mean([got[640 + i] == "block" for i in range(40)]) > 0.9


def test_counts_cover_all_rows_and_probabilities_match_brute_force(spark):
    urls = [f"ab{'cd'[i % 2]}" for i in range(50)]
    rows = spark.createDataFrame([(u, 0, 1) for u in urls], "url string, half int, kept int").repartition(5)
    m = url_filter._models(url_filter.ngram_counts(rows))[0, 1]
    symbol, contexts, _ = url_filter._contexts(["abc"])
    got = np.exp(m.logs(url_filter._cells(symbol, contexts)))
    text = ["\x01" * url_filter.ORDER + u + "\x02" for u in urls]
    want = []
    t = "\x01" * url_filter.ORDER + "abc\x02"
    for i in range(url_filter.ORDER, len(t)):
        p = 1 / url_filter.ALPHABET
        for n in range(url_filter.ORDER + 1):
            c = t[i - n:i]
            after = [x[j] for x in text for j in range(url_filter.ORDER, len(x)) if x[j - n:j] == c]
            if after:
                p = (after.count(t[i]) + len(set(after)) * p) / (len(after) + len(set(after)))
        want.append(p)
    assert got == pytest.approx(want, rel=1e-5)


def test_many_contexts_keep_their_own_counts(spark):
    """More contexts of five characters than 2**17; none may share counts with another."""
    r = random.Random(8)
    urls = ["".join(r.choice("0123456789abcdef") for _ in range(14)) for _ in range(20_000)]
    n, after = collections.Counter(), collections.defaultdict(set)
    for u in urls:
        t = "\x01" * url_filter.ORDER + u + "\x02"
        for i in range(url_filter.ORDER, len(t)):
            for k in range(url_filter.ORDER + 1):
                n[t[i - k:i + 1]] += 1
                after[t[i - k:i]].add(t[i])
    total = {c: sum(n[c + x] for x in a) for c, a in after.items()}
    assert sum(len(c) == url_filter.ORDER for c in after) > 2**17
    rows = spark.createDataFrame([(u, 0, 1) for u in urls], "url string, half int, kept int").repartition(5)
    asked = [*urls[:4], "00000fffff", "xyz"]
    symbol, contexts, _ = url_filter._contexts(asked)
    got = np.exp(url_filter._models(url_filter.ngram_counts(rows))[0, 1].logs(url_filter._cells(symbol, contexts)))
    want = []
    for u in asked:
        t = "\x01" * url_filter.ORDER + u + "\x02"
        for i in range(url_filter.ORDER, len(t)):
            p = 1 / url_filter.ALPHABET
            for k in range(url_filter.ORDER + 1):
                c = t[i - k:i]
                if c in after:
                    p = (n[c + t[i]] + len(after[c]) * p) / (total[c] + len(after[c]))
            want.append(p)
    assert got == pytest.approx(want, rel=1e-5)


def test_one_sided_and_empty_url_tables(spark):
    only = url_filter.judge(pages_of(spark, ["http://b.com/de/1", "http://x.net/"]), url_filter.RULES)
    assert {r["verdict"] for r in only.collect()} == {"block"}
    assert url_filter.judge(pages_of(spark, ["http://x.net/", None]), url_filter.RULES).where("verdict = 'allow'").count() == 2
    assert url_filter.judge(pages_of(spark, ["x"]).limit(0), url_filter.RULES).count() == 0


def test_ngrams_of_many_urls_are_not_broadcast(spark, monkeypatch):
    """The urls' file is small, what they look up is not; only lists of 256 and 65,536 n-grams at most may be sent."""
    plans, write = [], url_filter.write_and_read
    monkeypatch.setattr(url_filter, "write_and_read", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    r = random.Random(9)
    urls = [f"http://{r.choice(['a.org', 'b.com/de', 'c.net'])}/{r.randrange(10**9)}" for _ in range(1000)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert url_filter.judge(pages_of(spark, urls), url_filter.RULES).count() == len(urls)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scores, = (p for name, p in plans if name == "url-scores")
    assert "SortMergeJoin [gram" in scores and "Broadcast" not in scores
    assert ["BroadcastHashJoin" in p for name, p in plans if name == "url-probabilities"] == [False, True, True, False, False, False]


# --- main text --------------------------------------------------------------------

def test_sum_product_equals_enumeration():
    r = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    unary, pair = r.normal(size=(8, 3)), r.normal(size=(3, 3))
    total = np.zeros((8, 3))
    for code in range(3 ** 8):
        s = [code // 3 ** k % 3 for k in range(8)]
        w = math.exp(sum(unary[i, s[i]] for i in range(8)) + sum(pair[s[parent[i]], s[i]] for i in range(8) if parent[i] >= 0))
        for i in range(8):
            total[i, s[i]] += w
    assert main_text.sum_product(unary, pair, parent) == pytest.approx(total / total.sum(axis=1, keepdims=True))
    assert main_text.sum_product(np.zeros((0, 3)), pair, np.zeros(0, int)).shape == (0, 3)


@pytest.fixture(scope="module")
def model():
    return main_text.train()


CASES = [
    ("<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><article><h1>Big &amp; small</h1><p>First text, long enough to read.<p>Second <b>bold</b> one&nbsp;here.</article><footer>&copy; site</footer>",
     "Big & small First text, long enough to read. Second bold one here."),
    ("<body><div id=header>My site</div><div class=content><p>Some words of the story, and more of them.</p><ul><li>one item</li><li>two items</li></ul></div><div class=sidebar><p>Other things you may like to read, too.</p></div><div class='comments'><div class=comment><p>I like this very much, thanks a lot.</p></div></div>",
     "Some words of the story, and more of them. one item two items"),
    ("<main><p>Text one is here, it says much.</p><div class=ad>Buy now</div><p>Text two is here, it says more.</p></main><aside>see also</aside><form><label>Mail</label><input><button>Go</button></form><script>var a='<p>x</p>';</script><style>p{}</style>",
     "Text one is here, it says much. Text two is here, it says more."),
    ("<body><div class='cookie-notice'>We use cookies on this site, please agree to it.</div><article>Plain text only, in an article without any paragraph.</article><!-- <p>no</p> -->",
     "Plain text only, in an article without any paragraph."),
    ("", ""), (None, ""), ("<nav><a href=/>x</a></nav>", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_main_text_of_layouts(model, html, text):
    assert main_text.extract([html], model) == [text]


_ARTICLE = "<p>Some words of the story, and more of them, so that it is worth reading.</p><p>The second part of it, which is about as long as the first.</p>"


@pytest.mark.parametrize("html", [
    f"<body><form id='aspnetForm' method=post action=/x><input type=hidden name=s value=1><nav><a href=/>Home</a></nav><div class=content><h1>Big news</h1>{_ARTICLE}</div><div class=footer>&copy; site</div></form>",
    f"<body><form id=form1><div class=wrapper><div id=header><a href=/>My site</a></div><article><h1>Big news</h1>{_ARTICLE}</article></div></form>",
    f"<body><form><main><h1>Big news</h1>{_ARTICLE}</main><select><option>One</option></select><button>Go</button></form>",
    f"<body><article><h1>Big news</h1>{_ARTICLE}</article><form class=search action=/s>Search this site <input name=q><button>Go</button></form>",
    f"<body><form action=/login class=login><p>Log in to comment</p><input><button>Go</button></form><article><h1>Big news</h1>{_ARTICLE}</article>"])
def test_a_form_around_the_page_is_no_boilerplate(model, html):
    assert main_text.extract([html], model) == ["Big news " + re.sub("<[^>]+>", " ", _ARTICLE.replace("</p><p>", " ")).strip()]


def test_marginals_on_held_out_layouts(model):
    right = total = 0
    for page, y in main_text.labelled_pages(150, seed=77):
        p = model.marginals([page])[0]
        for node, t in page.text:
            if t.strip() and page.tag[node] not in main_text.NEVER:
                total += 1
                right += (p[node, main_text.BOILERPLATE] < 0.5) == (y[node] != main_text.BOILERPLATE)
    assert right / total > 0.97


@pytest.mark.parametrize("html, text", [
    ("a<br>b<p>c", "a b c"), ("x &lt;y&gt; &#233;&eacute;", "x <y> éé"), ("<p>un<b>do</b>ne</p>", "undone"), ("1 < 2 <p title='>'>z", "1 < 2 z"),
    ("a<script>b</script>c<style>d", "ac"), ("a <!-- b > c", "a"), ("a<!-- b -->c", "ac"), ("<p cla", ""), ("a</p>b</div>c", "a bc"),
    ('<p title="never closed>a</p><p>b', "a b"), ("<td>a<td>b", "a b"), ("<TITLE>t</TITLE><P>A\u00a0 \n b", "A b"), ("<", "<"), ("</", ""), ("<!", "")])
def test_forgiving_reader(html, text):
    assert dom.visible_text(html) == text


def test_main_text_query(spark, tmp_dir):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0], "x"), (None, "u", "<article><p>Deep " + "<div>" * 3000 + "text is read, too.", None)]
    sf = write_tables(tmp_dir, spark, pages=spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = main_text.op7_main_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["url"]: r["text"] for r in out if r["url"] and r["url"] != "u"} == {f"u{i}": t for i, (_, t) in enumerate(CASES)}
    assert [r["text"] for r in out if r["url"] is None] == [CASES[0][1]]


def test_words_in_chunks_are_those_of_whole_texts():
    texts = [sentence(i, 400) for i in range(30)]
    whole, _ = T.shingles(texts)
    parts = np.concatenate([T.shingles(p)[0] for _, p in T.chunks(texts, 5000)])
    assert (whole == parts).all()
