"""Main-text extraction and URL rules."""

import fnmatch
import itertools
import random
import re

import numpy as np
import pytest

from verdictlake.llm import html_extract as H
from verdictlake.llm import url_filter as U


@pytest.fixture(scope="module")
def model():
    return H.trained()


def text(html, model):
    return H.main_texts([html], model)[0]


def test_held_out_pages(model):
    pages = [H.parse(p) for p in H.labelled_pages(80, seed=501)]
    f = H.plant(pages, model.vocab.get)
    marginal, _ = H.messages(f, H.unaries(f, model.unary), model.pair)
    truth = H.labels_of(f, pages) == H.CONTENT
    assert ((marginal[:, H.CONTENT] > 0.5) == truth).mean() > 0.98


def test_messages_equal_brute_force(model):
    page = H.parse('<body><div class="ad"><p>x</p></div><article><p>y</p></article></body>')
    f = H.plant([page], model.vocab.get)
    score = H.unaries(f, model.unary)
    n = len(f.parent)
    weights = {}
    for labels in itertools.product(range(H.LABELS), repeat=n):
        w = sum(score[i, y] for i, y in enumerate(labels))
        w += sum(model.pair[f.kind[i], labels[f.parent[i]], labels[i]] for i in range(n) if f.parent[i] >= 0)
        weights[labels] = np.exp(w)
    total = sum(weights.values())
    marginal, joint = H.messages(f, score, model.pair)
    for i in range(n):
        for y in range(H.LABELS):
            assert marginal[i, y] == pytest.approx(sum(w for labels, w in weights.items() if labels[i] == y) / total)
    assert joint[1].sum() == pytest.approx(1)


def test_article_without_its_surroundings(model):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav>"
        '<!-- ad --><div class="ad">Buy it now.</div><article><h1>A &amp; B</h1><p><b>One  two\n three.<br><p>Four &eacute;.</p></article><footer>&copy; site. All of it.</footer>'
    )
    assert text(html, model) == "A & B\nOne two three.\nFour é."


def test_parts_inside_the_article_go(model):
    html = (
        "<body><main><h1>Title here</h1><p>Hello &amp; bye.<p>Two<br>lines <i>a</i>b.<div class='ad'>buy now</div><aside>See also this text here.</aside>"
        "<form><input><button>Go</button> Subscribe now</form></main><section class='comments'><div><p>First comment, a great article.</p></div></section><div class='cookie-notice'>We use cookies.</div></body>"
    )
    assert text(html, model) == "Title here\nHello & bye.\nTwo lines ab."


@pytest.mark.parametrize(("html", "out"), [("", ""), ("just text", "just text"), ("<p>a < b", "a < b"), ("<script>x", ""), ("<<<>>>", None)])
def test_odd_sources(model, html, out):
    got = text(html, model)
    assert out is None or got == out


def test_extract_keeps_every_row(spark, model):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi there, reader.</p></article>", 1), (1, "u", "<article><p>Hi there, reader.</p></article>", 1), (2, None, None, 2), (None, "v", "", 3)], "page_id long, url string, html string, text int")
    rows = H.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "Hi there, reader.", 17), (1, "Hi there, reader.", 17), (2, "", 0)]
    assert H.extract(pages.limit(0)).count() == 0


# -- URL rules -----------------------------------------------------------------------------------


def brute(host, path, rules):
    fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, "allow")


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "m.example.com", "xexample.com", "EXAMPLE.com", "net", "a.example.net", "org", "", "exam.plecom"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/77", "/de/8", "/de/9", "/es/", "/x.com/en/", "/EN/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?en/=/en/", "#top")]
    urls += [None, "", "no scheme", "a://b://c.com/en/", "http://com", "//com/en/", "http://" + "a." * 3000 + "com/en/1"]
    rows = U.filter_urls(spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string"), U.contract_rules()).collect()
    assert len(rows) == len(urls)
    for r in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == brute(host, path, U.CONTRACT_RULES)
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), U.contract_rules()).count() == 0


def test_globs_over_many_words():
    globs = ["*a?c/**z$", "**x", "ab*", "?b?/c", "lit.eral", *(f"w{i}*end" for i in range(40))]
    machine = U.Automaton([U.Rule(g, g, "block", len(g)) for g in globs])
    assert machine.words > 2
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcxz/.w") for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["w7 and end", "w39/end", "lit.eral!"]
    got = machine.match(texts)
    for k, g in enumerate(globs):
        body, open_ = (g[:-1], "") if g.endswith("$") else (g, ".*")
        parts = re.split(r"(\*\*|\*|\?)", body)
        pattern = re.compile("(?s)" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + open_)
        assert got[:, k].tolist() == [bool(pattern.fullmatch(t)) for t in texts], g
    assert fnmatch.fnmatch("ab", "a?")


@pytest.mark.parametrize(("tag", "kept"), [('<svg class="rule"/>', True), ("<math />", True), ("<SVG/>", True), ("<svg a='/>' b/>", True), ('<svg class="rule">', True), ("<svg class=rule/>", True), ("<svg><g>", True), ("<title/>", False)])
def test_drawings_and_formulas_leave_the_page_whole(tag, kept):
    page = H.parse(f"<article><p>One.</p>{tag}<p>Two.</p><p>Three.</p></article>")
    assert [run for _, run in page.runs] == (["One.", "Two.", "Three."] if kept else ["One."])


def extracted(page):
    return H.main_texts([page], H.trained())[0]


def test_foreign_elements_end_where_html_says():
    wrap = lambda inner: f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1>{inner}</article></body></html>"
    assert extracted(wrap("<p>One first para here.</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p>")).endswith("One first para here.\nLet x=2 be given.")
    assert extracted(wrap("<p>One first para here.</p><p>See <object data='a'>the plain text</object> of it.</p>")).endswith("See the plain text of it.")
    for svg in ("<svg width='3'/>", "<svg><path d='M0'/><text>no</text></svg>", "<svg><g><svg><text>no</text></svg></g></svg>"):
        assert extracted(wrap(f"<p>{svg} One first para here.</p><p>Second para stands here.</p>")).endswith("One first para here.\nSecond para stands here.")
    assert extracted(wrap("<p>One first para here.</p><svg><path d='M0'/><p>Second para stands here.</p>")).endswith("One first para here.\nSecond para stands here.")
    assert extracted(wrap("<p>One first para here.</p><p title=it's>Second 'para' stands here.</p>")).endswith("One first para here.\nSecond 'para' stands here.")


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<a title="', "<svg>", "<p>x", "<b><i></b>", "</x", "<?", "< ", "&amp"])
def test_time_grows_with_the_length(piece):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        H.parse(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_deeply_nested_and_very_long_pages():
    deep = "<div>" * 5_000 + "<p>Some words of text stand here.</p>" + "</div>" * 5_000
    assert len(H.parse(deep).parent) == 5_002
    paras = [f"Paragraph number {i} says a thing or two, and then a little more." for i in range(20_000)]
    assert extracted("<html><body><article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article></body></html>") == "\n".join(paras)


def test_unknown_names_lose_little():
    import random
    import re

    rng, held = random.Random(1), [0, 0, 0]
    names = {}
    rename = lambda w: names.setdefault(w[0], "".join(rng.choice("bcdfghjklm") + rng.choice("aeiou") for _ in range(3)))
    model = H.trained()
    for source in H.labelled_pages(120, seed=77):
        source = re.sub(r'((?:class|id)=")([^"]*)"', lambda x: x[1] + re.sub("[a-z]+", rename, x[2]) + '"', source)
        page = H.parse(source)
        f = H.plant([page], model.vocab.get)
        marginal, _ = H.messages(f, H.unaries(f, model.unary), model.pair)
        for node, run in page.runs:
            kept, told = marginal[node, H.CONTENT] > 0.5, node in page.label
            held[0] += len(run) * (kept and told)
            held[1] += len(run) * (kept and not told)
            held[2] += len(run) * (told and not kept)
    assert held[0] / (held[0] + held[1]) > 0.8 and held[0] / (held[0] + held[2]) > 0.8
