import pytest

from tessera.llm import html as H
from tessera.llm import labelled as L


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(L.labelled_pages(spark))


def test_held_out_labelled_pages(model):
    right = wrong = missed = 0
    for k in range(200):
        nodes = H.parse(L._Writer(7_000_000 + k).page())
        for node, state, share in zip(nodes, H._states(nodes), model.marginals(nodes)):
            if node.leaf:
                kept, good = share >= 0.5, state == H.CONTENT
                right += node.chars * (kept and good)
                wrong += node.chars * (kept and not good)
                missed += node.chars * (good and not kept)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def page(body):
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_main_text(model):
    config = H.HtmlConfig()
    body = (
        '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- <p>no</p> -->'
        '<div class="ad">Buy this now. It is good.</div><article><h1>The &amp; title</h1>'
        "<p><b>First&nbsp;words\n of a  text.<br>More of it here, and so on.<p>Second one ends here, s<i>ooner</i> than some.</p>"
        '<script>var t="</p>";</script><aside><p>Related things to read. And more.</p></aside><p>Third paragraph is this one.</p>'
        "<form><label>Name</label><input><button>Send</button></form></article>"
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>Bob</p><p>I like it. It is nice.</p></div></section>'
        "<footer>&copy; 2020 &middot; Some site and its owner.</footer>"
    )
    want = "The & title First words of a text. More of it here, and so on. Second one ends here, sooner than some. Third paragraph is this one."
    assert model.main_text(page(body), config) == want
    assert model.main_text(page(body).replace("</body></html>", ""), config) == want


@pytest.mark.parametrize("text", [
    "<", "<p", "<!--", "</", "<a href=\"x>y", "&am", "<p>" * 3000, "<div>" * 5000 + "deep", "</p></div>", "<script>never closed",
    "<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i><li></li>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000,
    "<a>" * 20_000 + "</b><p></p>" * 20_000, "<a '\"x>" * 30_000, "<!-- x -->" * 20_000,
    "<table><tr><td>a<td>b<tr><td>c", "\x00<p>퟿</p>", "<p class=>x</p>", "<svg/><p>x</p>", "a < b and c > d",
])
def test_broken_pages_do_not_fail(model, text):
    assert isinstance(model.main_text(text, H.HtmlConfig()), str)


def test_marginals_are_exact_on_a_small_tree(model):
    nodes = H.parse(page('<div class="x"><p>One two. Three.</p><a class="ad" href=x>buy</a></div><p>End of it.</p>'))
    names = [[], *(H.features(n, nodes) for n in nodes[1:])]
    own, (element, run) = model.own(nodes, names), model.moves()
    run = H._runs(run)
    total, content = 0.0, [0.0] * len(nodes)
    import itertools
    for states in itertools.product(range(3), repeat=len(nodes)):
        weight = own[0][states[0]]
        for i, node in enumerate(nodes[1:], 1):
            weight *= own[i][states[i]] * (run if node.leaf else element)[states[node.parent]][states[i]]
        total += weight
        for i, s in enumerate(states):
            content[i] += weight * (s == H.CONTENT)
    assert model.marginals(nodes) == pytest.approx([c / total for c in content], abs=1e-9)


def test_operator(spark, model):
    article = page("<article><h1>Head</h1><p>Some text that is long enough. Really so.</p></article>")
    rows = [(1, "u", article, "t"), (1, "u", article, "t"), (None, None, None, None), (4, "v", "", "t"), (5, "w", page("<p>" + "Long text here. " * 60_000), "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(frame, model).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[1] == "Head Some text that is long enough. Really so." and by_id[None] == by_id[4] == ""
    assert len(by_id[5]) > 900_000
    assert H.extract(frame.limit(0), model).collect() == []


def test_all_names_of_an_attribute_are_features():
    from tessera.llm.html import features, parse

    nodes = parse('<div class="col-xs-12 col-sm-4 col-md-3 hidden-print clearfix sidebar" id="aa-bb-cc-dd-ee-ff-gg-hh-comments">x</div>')
    assert {"name sidebar", "name clearfix", "name comments"} <= set(features(nodes[1], nodes))
    assert len(nodes[1].names) == len(set(nodes[1].names))


ARTICLE = ["One is a paragraph of some words. It has two sentences.", "Two is another of them. It ends here.", "Three follows with more text. And so on.", "Four is the last one. It closes the page."]


@pytest.mark.parametrize("tag", ["object", "noscript", "iframe", "template", "math", "svg", "title", "embed", "noframes"])
def test_an_element_without_an_end_tag_swallows_nothing(model, tag):
    body = "<article><h1>Head of it</h1>" + f"<{tag}>".join(f"<p>{t}</p>" for t in ARTICLE[:2]) + "".join(f"<p>{t}</p>" for t in ARTICLE[2:]) + "</article>"
    assert model.main_text(page(body), H.HtmlConfig()) == " ".join(["Head of it", *ARTICLE])


def test_formulas_and_objects_of_an_article_stay(model):
    body = "<article><h1>Head of it</h1><p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, as we know. It is so.</p><p>And <object data=x>a picture</object> of it. That was all.</p></article>"
    assert model.main_text(page(body), H.HtmlConfig()) == "Head of it The energy is E=m here, as we know. It is so. And a picture of it. That was all."


def test_features_read_whole_runs():
    late = H.parse("<p>" + "word " * 200 + "© 2020 somebody</p>")
    assert "copyright" in H.features(late[-1], late)
    first = H.parse("<p>One. Two. Three. " + "word " * 300 + "</p>")
    assert "ends 3" in H.features(first[-1], first)


def test_deep_inline_elements_close():
    nodes = H.parse("<p><a href=x>" + "<b>" * 300 + "link" + "</b>" * 300 + "</a>plain <i>text</i></p><p><a>" + "<i>" * 400 + "x</a>after</p>")
    assert sum(n.linked for n in nodes if n.leaf) == len("link") + len("x")
    assert sum(n.chars for n in nodes if n.leaf) == len("linkplaintextxafter")
