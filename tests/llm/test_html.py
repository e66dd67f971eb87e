"""Extraction from made-up pages of several layouts, against the texts they were made of."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from viewloom.llm import html
from viewloom.llm.html import SLOT, extract, fold, n_slots, stream


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def article(rng, host):
    paragraphs = [words(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
    title = words(rng, 3)
    menu = "<ul class='menu'>" + "".join(f"<li><a href='/{i}'>Menu {i}</a>" for i in range(rng.randint(2, 6))) + "</ul>"
    notes = "".join(f"<li><p>{words(rng, 6)}</p></li>" for _ in range(rng.randint(0, 3)))
    body = "".join(f"<p>{p}</p>\n" for p in paragraphs)
    layouts = {
        "a": f"<body><header><h2>Site</h2></header>{menu}<main><h1>{title}</h1>{body}</main><aside>{words(rng, 5)}</aside><footer>&copy; x",
        "b": f"<body><div id=top-nav>{menu}</div><div class='article'><h1>{title}</h1>{body}<div class='ad-box'>Buy {words(rng, 2)}</div></div><section id='comments'><ul>{notes}</ul></section>",
        "c": f"<body><nav>{menu}</nav><div><h1>{title}</h1>{body}</div><div>All rights kept</div><form><p>Your mail</p></form>",
    }
    return "<!doctype html><html><head><title>t</title><script>if (a<b) '</p>'</script></head>" + layouts[host], "\n\n".join([title, *paragraphs])


def test_layouts(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(45):
        host = "abc"[i % 3]
        page, text = article(rng, host)
        rows.append((i, f"https://{host}.example.org/{i}", page, "x"))
        want[i] = text
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_articles_below_marked_wrappers(spark):
    rng, rows, want = random.Random(5), [], {}
    wraps = {
        "x": "<div class='content-sidebar-wrap'><main><article>%s</article></main><div class='sidebar'><p>Side %d</p></div></div>",
        "y": "<div class='widget container'><article>%s</article></div><div class='related'><p>Other %d</p></div>",
        "z": "<main><article>%s</article></main><div class='related'><article><p>Teaser %d</p></article></div>",
    }
    for host, wrap in wraps.items():
        for i in range(6):
            a, b, c = words(rng, 4), words(rng, 9), words(rng, 12)
            body = f"<h2 id='search'>{a}</h2><p>{b}</p><h2 id='related-work'>{host}{i}</h2><p>{c}</p>"
            key = len(rows)
            rows.append((key, f"http://{host}.org/{i}", f"<html><body><nav><a>Menu</a></nav>{wrap % (body, i)}</body></html>"))
            want[key] = "\n\n".join([a, b, f"{host}{i}", c])
    for i in range(6):  # an article that only points elsewhere
        a, b = words(rng, 9), words(rng, 12)
        want[len(rows)] = f"{a}\n\n{b}"
        rows.append((len(rows), f"http://v.org/{i}", f"<html><body><div><div>{a}</div><section>{b}</section></div><div class='related'><article><p>Teaser {i}</p></article></div></body></html>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def wrapped(rows, emptied=False):
    """The texts of pages of one host by one wrapper of them all, or by none."""
    parsed = [stream(page) for page in rows]
    folded = [fold(tokens) for tokens, _ in parsed]
    by_print = {}
    for (skeleton, slots), (_, texts) in zip(folded, parsed, strict=True):
        seen = by_print.setdefault(str(skeleton), (skeleton, {}, []))
        for k, t in zip(slots, texts, strict=True):
            seen[1].setdefault(k, set()).add(t if slots.count(k) == 1 else None)
        seen[2].append(1)
    made = []
    for skeleton, texts, n in by_print.values():
        known = lambda found: html.UNKNOWN if not found or None in found else html.VARIES if len(found) > 1 else str(hash(next(iter(found))))
        constant = [known(texts.get(k)) for k in range(sum(map(n_slots, skeleton)))]
        made = html.align(made, html.start(skeleton, constant, len(n)))
    out = []
    for (skeleton, slots), (_, texts) in zip(folded, parsed, strict=True):
        keep = html.mask([] if emptied else made, skeleton)
        out.append("\n\n".join(t for k, t in zip(slots, texts, strict=True) if keep[k] == "1"))
    return out


def test_wrappers_decide_inside_articles(spark):
    """Text that stays while the article changes goes, wherever it is; without a wrapper it would stay."""
    rng, pages, want = random.Random(8), [], []
    for i in range(9):
        title, first, rest = words(rng, 3), words(rng, 9), [words(rng, 6) for _ in range(rng.randint(1, 3))]
        quote = f"<blockquote>{words(rng, 4)}</blockquote>" if i % 3 == 0 else ""
        pages.append(f"<body><article><h1>{title}</h1><h2>Summary</h2><div>{first}</div>{quote}<ul>{''.join(f'<li>{r}</li>' for r in rest)}</ul><section>Follow us for more of this</section></article><div>Made by us</div></body>")
        want.append([title, "Summary", first, *([quote[12:-13]] if quote else []), *rest])
    want = ["\n\n".join(w) for w in want]
    assert wrapped(pages) == want and wrapped(pages, emptied=True) == [f"{w}\n\nFollow us for more of this" for w in want]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == want
    # copies of one article in other surroundings keep all of it
    copies = [p.replace("Made by us", f"Made by {i}") for i, p in enumerate([pages[1]] * 8)]
    assert wrapped(copies) == [f"{want[1]}\n\nFollow us for more of this"] * 8


def test_names_that_say_something_else(spark):
    page = "<article><h1>T</h1><div class='side-by-side'>one</div><p class='share-price'>two</p><section id='search-for-life'>three</section><p>a <math><mi>x</mi></math> b <object>c</object></p><div class='share-buttons'>no</div><div class='ad-59'>no</div><div id='related-posts'>no</div></article>"
    assert [r.text for r in extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()] == ["T\n\none\n\ntwo\n\nthree\n\na x b c"]


def test_long_groups_fold():
    body = "".join(f"<div class='k{chr(97 + k)}'><p>t</p></div>" for k in range(20))
    skeleton, slots = fold(stream(f"<main>{body * 4}</main>")[0])
    assert sum(map(n_slots, skeleton)) == 20 and slots == list(range(20)) * 4


def test_odd_pages(spark):
    pages = [None, "", "   ", "just text", "<p>a &amp; b&nbsp; c<br>d", "<article><p>x<p>y</article", "<article>" + "<p>z</p>" * 3000, "<p hidden>no</p><p>yes", "a < b <", "<article><p>x</p>tail</article>"]
    want = ["", "", "", "just text", "a & b c d", "x\n\ny", "\n\n".join(["z"] * 3000), "yes", "a < b <", "x\n\ntail"]
    rows = [(i, None if i % 2 else f"http://h{i}.org/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "x", "<li>", "<ul>", "</ul>", "<div class=a>", "</div>", " ", "<b>", "<br>"]), max_size=60))
def test_fold_numbers_every_slot(parts):
    tokens, texts = stream("".join(parts))
    skeleton, slots = fold(tokens)
    assert len(slots) == len(texts) == tokens.count(SLOT)
    assert set(slots) == set(range(sum(map(n_slots, skeleton))))


def test_a_wrapper_of_many_items_takes_in_all_parts():
    many = [t for i in range(3000) for t in (f"<div c{'abcdefghij'[i % 10]}{i}>", "#", "</div>")]
    late = ["<section z>", "#", "</section>"]
    made = html.start(many, [html.VARIES] * 3000)
    made = html.align(made, html.start(late, ["7"], 3))
    assert html.mask(made, late) == "0"  # the same text on three pages
    assert len(made) == len(many) + len(late)
