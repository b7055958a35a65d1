"""Labelled pages for the extractor's weights: own, invented layouts; ``[[`` and ``]]`` bound the main text."""

_P = "<p>The river rose again on Monday and the old mill had to be closed for the day, the owner said in a short note.</p>"
_Q = "<p>Nobody was hurt, but the <a href='/x'>bridge road</a> stays shut until engineers have looked at both <b>pillars</b>.</p>"
_MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/c'>Contact us</a></li></ul>"
_NOTE = "<p>We use small files to make this site work and to measure how it is read. Choose what you allow.</p>"
_TALK = "<p>Great read, thanks a lot!</p><p>I do not agree, the mill was closed years ago and everyone in town knows that.</p>"


def _page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def _boxes(names: str, inner: str, kind: str = "div", attr: str = "class") -> str:
    return "".join(f"<{kind} {attr}='{n}'>{inner}</{kind}>" for n in names.split())


PAGES = [
    _page(f"<header><h2>The Daily Note</h2>{_MENU}</header><nav>{_MENU}</nav><article>[[<h1>Mill shut</h1>{_P}{_Q}{_P}]]</article><aside>{_P}{_MENU}</aside><footer><p>All rights reserved by the paper, its owners and its friends.</p></footer>"),
    _page(f"<div id='header'>{_MENU}</div><div id='main'><div class='post-content'>[[<h1>Two pillars</h1>{_P}<ul><li>closed road</li><li>open ferry</li></ul>{_Q}{_P}]]</div></div><div id='sidebar'>{_MENU}{_P}</div><div id='footer'>{_MENU}</div>"),
    _page(_boxes("cookie consent notice gdpr banner popup modal overlay alert", _NOTE) + f"<main>[[<h1>Ferry</h1>{_Q}<blockquote>{_P}</blockquote>{_P}]]</main>" + _boxes("comments comment discussion respond disqus replies reply thread", _TALK)),
    _page(_boxes("menu navbar navigation breadcrumb breadcrumbs toolbar topbar masthead", _MENU) + f"<div class='entry'>[[{_P}{_Q}]]" + _boxes("ad ads advert advertisement sponsor sponsored promo promotion", _P) + f"[[{_P}]]</div>" + _boxes("share sharing social related recommended recommendations more-stories teaser teasers trending popular newsletter subscribe signup", _P)),
    _page(f"<section class='article-body story text'>[[<h1>After the rain</h1>{_P}{_P}{_Q}]]</section><form><p>Sign up for our letter and never miss the news from the river.</p><label>Name</label><button>Send</button></form>" + _boxes("widget widgets side rail login search searchbox author-bio byline meta tags tagcloud pagination pager legal copyright disclaimer imprint", _P)),
    _page(f"<dialog>{_NOTE}</dialog><div role='main'>[[<h2>Water level</h2>{_P}<table><tr><td>Monday</td><td>high</td></tr></table>{_Q}]]</div><section id='comments'>{_TALK}</section>" + _boxes("banner navigation complementary contentinfo search dialog alertdialog form", _NOTE, "div", "role")),
    _page(f"<div class='wrapper container'><div class='content'>[[{_P}{_P}{_Q}{_Q}]]</div></div><div class='wrapper container'><div class='bottom'>{_MENU}</div></div><menu>{_MENU}</menu>"),
]
