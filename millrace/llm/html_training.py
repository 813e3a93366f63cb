"""Labelled pages from which the weights of the HTML extraction are learned.

Each is a page and its main text, blocks joined by an empty line.  They are built by a
rule: every layout of a page meets every side part under each of the names that pages
commonly give it, between two side parts that their elements tell.
"""

from __future__ import annotations

from collections.abc import Iterator

_P1 = "The river rises in the hills and runs for forty miles through farms and small towns before it meets the sea."
_P2 = "For most of its course it is slow and wide, and the meadows on both sides are flooded every spring."
_P3 = "Mills stood here for six hundred years; the last one closed when the railway came."
_P4 = "A short note."
_LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "About us", "Contact", "Archive", "Login"))

#: markup of a side part, with the names that such a part has
SIDES: tuple[tuple[str, str], ...] = (
    ("<div class='{}'>Buy now and save a lot of money today.</div>", "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promotions"),
    ("<div class='{}'><p>We use cookies to make this site better.</p> <button>Accept</button></div>", "cookie cookies consent gdpr notice notices popup modal"),
    ("<section id='{}'><article><p>I liked this one a lot, thank you.</p></article><article><p>So did I.</p></article></section>", "comment comments reply replies respond disqus"),
    ("<div id='{}'><p>Read our other stories here.</p><ul>" + _LINKS + "</ul></div>", "sidebar sidebars related recommended widget widgets"),
    ("<ul class='{}'>" + _LINKS + "</ul>", "menu menus nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager skip"),
    ("<div class='{}'>Terms and conditions apply, all rights reserved.</div>", "footer copyright masthead header legal"),
    ("<div class='{}'><p>Share this page with your friends.</p></div>", "share sharing social newsletter subscribe subscription signup login search"),
    ("<div class='{}'>An offer that is made only for you.</div>", "ad-banner cookie-notice share-buttons site-footer page-header main-menu side-nav top-banner social-links related-links comment-list login-form"),
)
#: markup of side parts that their elements tell
PLAIN_SIDES = (
    f"<nav><ul>{_LINKS}</ul></nav>",
    "<header><a href='/'>Site</a> <p>The site of the town</p></header>",
    "<footer>&copy; example.com &middot; all rights reserved</footer>",
    "<aside><a href='/a'>Related: roads</a><a href='/b'>Related: bridges</a></aside>",
    "<form>Your name <input name=n> <button>Send</button></form>",
    "<p>Text beside the article that is no part of it.</p>",
)
#: markup of a main text, and the text; {} takes a side part
LAYOUTS: tuple[tuple[str, str], ...] = (
    (f"<article><h1>The river</h1><p>{_P1}</p><p><b>{_P2}</b><br></p>{{}}<p>{_P3}</p></article>", f"The river\n\n{_P1}\n\n{_P2}\n\n{_P3}"),
    (f"<main><h2>Mills</h2><p>{_P3}</p>{{}}<p>{_P1} <a href='/x'>More on this</a> and <i>so on</i>.</p></main>", f"Mills\n\n{_P3}\n\n{_P1} More on this and so on."),
    (f"<article><h1>Short</h1><p>{_P4}</p></article>{{}}", f"Short\n\n{_P4}"),
    (f"<article><h1>Places</h1><ul><li>one thing to see</li><li>another thing to see</li></ul><blockquote>{_P3}</blockquote></article>{{}}", f"Places\n\none thing to see\n\nanother thing to see\n\n{_P3}"),
    (f"<div id='content'><h1>Notes</h1><p>{_P4}</p>{{}}<p>{_P2}</p><ul><li>one thing to see</li><li>another thing to see</li></ul></div>", f"Notes\n\n{_P4}\n\n{_P2}\n\none thing to see\n\nanother thing to see"),
    (f"<table><tr><td>{{}}</td><td><p>{_P2}</p><p>{_P1}</p></td></tr></table>", f"{_P2}\n\n{_P1}"),
    (f"<h1>Plain page</h1><p>{_P1}<p>{_P2}<p>{_P3}<hr>{{}}", f"Plain page\n\n{_P1}\n\n{_P2}\n\n{_P3}"),
    (f"<div class='has-sidebar'><div class='post'><h1>Mills</h1><p>{_P3}</p><p>{_P1}</p></div>{{}}</div>", f"Mills\n\n{_P3}\n\n{_P1}"),
    (f"<div class='with-comments no-footer'><article class='entry'><p>{_P3}</p><div><p>{_P1}</p></div></article>{{}}</div>", f"{_P3}\n\n{_P1}"),
    (f"<main><section class='related-work'><h2>Others</h2><p>{_P3}</p></section><section class='page-header-text'><p>{_P1}</p></section>{{}}</main>", f"Others\n\n{_P3}\n\n{_P1}"),
)


def _pages() -> Iterator[tuple[str, str]]:
    named = [(markup.format(name), name) for markup, names in SIDES for name in names.split()]
    for i, (side, _) in enumerate(named):
        for j, (layout, text) in enumerate(LAYOUTS):
            whole = "<article" in layout or "<main" in layout
            plain = [PLAIN_SIDES[(i + j + n) % (len(PLAIN_SIDES) if whole else len(PLAIN_SIDES) - 1)] for n in (0, 2)]
            yield f"<html><head><title>Page {i}</title></head><body>{plain[0]}{layout.format(side)}{plain[1]}</body></html>", text


LABELLED: tuple[tuple[str, str], ...] = tuple(_pages())
