"""Main text of hand-written layouts that the generator of training pages doesn't make."""

from __future__ import annotations

import difflib

import pytest

from evigrain.llm import html_crf

TEXT = [
    "The old bridge over the river was closed last spring, and nobody knows yet when it will be opened to traffic.",
    "Engineers found that two of the four pillars had moved by almost ten centimetres since they were last measured in 1998.",
    "A repair would cost about four million, the council said on Tuesday; a new bridge would cost three times as much.",
    "For the farmers on the other bank the way to town has become an hour longer. Some have begun to use boats.",
    "“We were told it would take six weeks,” one of them says. “Now it has been seven months.”",
    "The council will decide in May. Until then a ferry runs twice a day, free of charge for everybody who lives there.",
]
MENU = '<a href="/">Home</a> <a href="/news">News</a> <a href="/contact">Contact</a>'
LIST = '<ul><li><a href="/">Home</a><li><a href="/news">News</a><li><a href="/contact">Contact</a></ul>'
FOOT = "&copy; 2024 River Valley Post. All rights reserved."


def ps(tag: str = "<p>{}</p>", texts: list[str] = TEXT) -> str:
    return "\n".join(tag.format(t) for t in texts)


LAYOUTS = {
    "plain paragraphs": f"<body><div>{MENU}</div>{ps()}<div>{FOOT}</div>",
    "paragraphs of div in div": f"<body><div class=nav>{MENU}</div><div>{ps('<div>{}</div>')}</div><div class=foot>{FOOT}</div>",
    "unknown class": f'<body><div class=q1>{MENU}</div><div class="c1">{ps()}</div><div class=q9>{FOOT}</div>',
    "story": f'<body><div id="top">{LIST}</div><div class="story">{ps("<div>{}</div>")}</div><div id="bottom">{FOOT}</div>',
    "three deep": f"<body><div id=page><div id=a>{LIST}</div><div id=b><div><div>{ps()}</div></div></div><div id=z>{FOOT}</div></div>",
    "old table page": f"<body bgcolor=white><table width=100%><tr><td>{MENU}</td></tr><tr><td><table><tr><td valign=top>{ps()}</td></tr></table></td></tr><tr><td><font size=1>{FOOT}</font></td></tr></table>",
    "heading and blocks": f"<body><header><nav>{LIST}</nav></header><main><h1>Bridge stays closed</h1>{ps()}</main><footer>{FOOT}</footer>",
    "unquoted slashes": f"<body><script src=/js/>var menu = 1; open(menu);</script><style type=text/css/>p {{ color: red }}</style><div class=nav data-u=/a/>{MENU}</div><div data-x=/b/>{ps()}</div><div class=footer>{FOOT}</div>",
    "sidebar with links": f"<body><div class=k1>{LIST}</div><div class=k2>{ps()}</div><div class=k3><h3>More</h3><ul><li><a href=1>Ferry times</a><li><a href=2>Water levels</a><li><a href=3>Council meets</a></ul></div><div>{FOOT}</div>",
    "advert between": f"<body><div id=nav>{LIST}</div><article>{ps(texts=TEXT[:3])}<div class='ad-slot'>Buy boots now. Half price this week only.</div>{ps(texts=TEXT[3:])}</article><footer>{FOOT}</footer>",
    "comments below": f"<body><nav>{LIST}</nav><div class='entry'>{ps()}</div><div id='comments'><h3>2 comments</h3><div class='comment'><p>I have seen the pillars move myself, believe me.</p></div><div class='comment'><p>Nobody asked us about any of this.</p></div></div><footer>{FOOT}</footer>",
    "spans in divs": f"<body><div class=bar>{MENU}</div><div class=s4>{ps('<div class=s5><span>{}</span></div>')}</div><div class=bar2>{FOOT}</div>",
    "line breaks": f"<body><div class=menu>{MENU}</div><div class=t7>{'<br><br>'.join(TEXT)}</div><div class=footer>{FOOT}</div>",
    "quotes and lists": f"<body><nav>{LIST}</nav><section class=x>{ps(texts=TEXT[:2])}<blockquote>{TEXT[4]}</blockquote><ul><li>{TEXT[2]}</li><li>{TEXT[3]}</li></ul>{ps(texts=TEXT[5:])}</section><footer>{FOOT}</footer>",
    "cookie notice first": f"<body><div class='cookie-banner'><p>We use cookies to make this site better. By going on you agree to them.</p><button>OK</button></div><div>{MENU}</div><div class=m><h2>Bridge stays closed</h2>{ps()}</div><div>{FOOT}</div>",
    "search form": f"<body><div>{MENU}<form action=/s><label>Search the site</label><input name=q></form></div><div class=wrap>{ps()}</div><form class=newsletter><p>Get our letter every week.</p><input name=mail></form><div>{FOOT}</div>",
    "capital tags": f"<BODY><DIV CLASS=NAV>{MENU}</DIV><DIV CLASS=BODYTEXT>{ps('<P>{}')}</DIV><DIV CLASS=FOOTER>{FOOT}</DIV></BODY>",
    "links in the text": f"<body><nav>{LIST}</nav><div class=z3>{ps('<p>{}</p>').replace('council', '<a href=/c>council</a>').replace('ferry', '<a href=/f>ferry</a>')}</div><footer>{FOOT}</footer>",
    "formula": f"<body><nav>{LIST}</nav><main>{ps()}<p>Let the number <math><mi>x</mi> <mo>=</mo> <mn>42</mn></math> be the load in tonnes.</p></main><footer>{FOOT}</footer>",
}
MORE = {"heading and blocks": ("Bridge stays closed", 0), "cookie notice first": ("Bridge stays closed", 0), "formula": ("Let the number x = 42 be the load in tonnes.", 9)}
ORDER = {"quotes and lists": [0, 1, 4, 2, 3, 5]}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    texts = [TEXT[i] for i in ORDER.get(name, range(6))]
    if name in MORE:
        texts.insert(MORE[name][1], MORE[name][0])
    want, got = " ".join(texts), html_crf.main_text(LAYOUTS[name], html_crf.model())
    same = sum(m.size for m in difflib.SequenceMatcher(None, want, got, autojunk=False).get_matching_blocks())
    assert same >= 0.99 * len(want), got
    assert len(got) - same <= 0.01 * len(want), got


def test_slashes_close_only_foreign_elements():
    def texts(page):
        return [b.text for b in html_crf.blocks(page)]

    assert texts("<p>a<script src=/a/>var x</script>b<script/>c</script>d") == ["a", "b", "d"]
    assert texts("<div/>one<p>two</div>three") == ["one", "two", "three"]
    assert texts("<p>one<svg/>two<svg width=1/>three</svg>four<svg a='x'/>five<svg><title/>six</svg>seven") == ["one", "two", "four", "five", "seven"]
    assert texts("<p>one<svg><style/><path d=a/></svg>two<style>p{}</style>three") == ["one", "two", "three"]
    assert texts("<p>x <math><mi>a</mi><annotation>tex</annotation></math> y") == ["x a y"]
