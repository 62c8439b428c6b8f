"""Labelled pages for the HTML model: built from parts by a seeded rule, so their labels are known.

A page is a layout with one content container among page furniture. Every part that is
content carries the attribute ``data-gold``, which only the trainer reads.
"""

from __future__ import annotations

import random

WORDS = "river stone garden winter letter market engine forest paper window morning story teacher village music history number island bridge summer doctor kitchen journey captain".split()
FURNITURE = [
    '<nav><ul>{links}</ul></nav>', '<nav class="{navish}">{inline_links}</nav>', '<header><a href="/">{few}</a>{inline_links}</header>', '<header class="site-header"><h1>{few}</h1><p>{few}</p></header>',
    '<div class="{navish}"><ul>{links}</ul></div>', '<ul class="{navish}">{links}</ul>', '<div id="{navish}">{inline_links}</div>', '<footer>&copy; {few} &middot; {some}</footer>', '<footer class="site-footer"><p>{some}</p>{inline_links}</footer>', '<div class="footer">{few} {inline_links}</div>',
    '<aside><h3>{few}</h3><ul>{links}</ul></aside>', '<aside class="sidebar"><p>{some}</p></aside>', '<div class="sidebar"><h3>{few}</h3><p>{some}</p></div>', '<div id="sidebar"><ul>{links}</ul></div>', '<section class="related"><h2>{few}</h2><ul>{links}</ul></section>', '<div class="related-posts">{inline_links}</div>',
    '<div class="{adish}">{some}</div>', '<div class="{adish}"><p>{some}</p><a href="/x">{few}</a></div>', '<div id="{adish}"><p>{some}</p></div>', '<section class="{adish}"><h4>{few}</h4><p>{some}</p></section>', '<aside class="{adish}">{some}</aside>',
    '<div class="{noticeish}">{some} <button>{few}</button></div>', '<div class="{noticeish}"><p>{some}</p></div>', '<div id="{noticeish}" role="dialog"><p>{some}</p></div>', '<div role="alert">{some}</div>', '<p class="{noticeish}">{some}</p>',
    '<form action="/s"><label>{few}</label><input name="q"><button>{few}</button></form>', '<form class="subscribe"><p>{some}</p><input><button>{few}</button></form>', '<div class="newsletter"><p>{some}</p><form><input></form></div>',
    '<section class="{commentish}"><h2>{few}</h2>{comments}</section>', '<div id="{commentish}"><h3>{few}</h3>{comments}</div>', '<div class="{commentish}">{comments}</div>', '<ol class="comment-list">{comment_items}</ol>', '<ul class="{commentish}">{comment_items}</ul>',
    '<div class="share">{inline_links}</div>', '<div class="breadcrumb">{inline_links}</div>', '<ul class="pagination">{links}</ul>', '<div class="tags">{inline_links}</div>', '<div role="navigation">{inline_links}</div>', '<div role="complementary"><p>{some}</p></div>', '<div role="contentinfo"><p>{some}</p></div>', '<div role="banner"><p>{few}</p></div>', '<p>{inline_links}</p>',
]
KINDS = {
    "navish": "nav menu main-menu navbar navigation topnav site-nav nav-links".split(),
    "adish": "ad ads advert advertisement ad-banner sponsored promo banner sponsor ad-slot adbox".split(),
    "noticeish": "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal notification paywall disclaimer".split(),
    "commentish": "comments comment comments-area reader-comments comment-section discussion responses replies".split(),
}
HOLDERS = ["<article>{}</article>", "<article>{}</article>", '<main><article>{}</article></main>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="article-body">{}</div>', '<div class="post-content">{}</div>', '<div class="entry"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', '<div id="main"><div class="post">{}</div></div>', '<div class="page"><div class="text">{}</div></div>', '<div role="main">{}</div>', "<div>{}</div>", '<div itemprop="articleBody">{}</div>']


def _text(rng: random.Random, low: int, high: int) -> str:
    ws = [rng.choice(WORDS) for _ in range(rng.randint(low, high))]
    return " ".join([ws[0].capitalize(), *ws[1:]]) + rng.choice([".", ".", ".", "?", "!", ""])


def _fill(rng: random.Random, part: str) -> str:
    link = lambda: f'<a href="/{rng.choice(WORDS)}">{_text(rng, 1, 3)}</a>'
    comment = lambda: f'<p>{_text(rng, 3, 30)}</p>'
    values = {k: rng.choice(v) for k, v in KINDS.items()} | {
        "links": "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7))),
        "inline_links": " ".join(link() for _ in range(rng.randint(2, 6))),
        "few": _text(rng, 1, 4),
        "some": _text(rng, 4, 25),
        "comments": "".join(rng.choice(['<div class="comment">{}</div>', "{}", '<div class="comment-body">{}</div>', "<article class=\"comment\">{}</article>"]).format(comment()) for _ in range(rng.randint(1, 4))),
        "comment_items": "".join(f'<li class="comment">{comment()}</li>' for _ in range(rng.randint(1, 4))),
    }
    return part.format(**values)


def _content(rng: random.Random) -> str:
    gold = lambda tag, text: f"<{tag} data-gold>{text}</{tag}>"
    out = [gold(rng.choice(["h1", "h1", "h2"]), _text(rng, 2, 12))] if rng.random() < 0.9 else []
    for _ in range(rng.randint(1, 9)):
        kind, text = rng.random(), _text(rng, rng.choice([1, 8, 20]), rng.choice([20, 60, 120]))
        if kind < 0.62:
            out.append(gold("p", text))
        elif kind < 0.7:
            out.append(gold("p", f'{text} <a href="/y">{_text(rng, 1, 3)}</a> {_text(rng, 4, 20)}'))
        elif kind < 0.77:
            out.append(gold(rng.choice(["h2", "h3", "h4"]), _text(rng, 1, 7)))
        elif kind < 0.83:
            out.append("<ul>" + "".join(gold("li", _text(rng, 2, 15)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.87:
            out.append(gold("blockquote", text))
        elif kind < 0.9:
            out.append("<table><tr>" + "".join(gold("td", _text(rng, 1, 5)) for _ in range(3)) + "</tr></table>")
        elif kind < 0.93:
            out.append(f"<figure><img>{gold('figcaption', _text(rng, 3, 12))}</figure>")
        elif kind < 0.96:
            out.append(gold("div", text))
        else:
            out.append(gold("pre", text))
    for _ in range(rng.choice([0, 0, 0, 1, 2])):  # furniture inside the article
        out.insert(rng.randint(0, len(out)), _fill(rng, rng.choice(FURNITURE)))
    return "".join(out)


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    rng, pages = random.Random(seed), []
    for _ in range(n):
        before = [_fill(rng, rng.choice(FURNITURE)) for _ in range(rng.randint(0, 4))]
        after = [_fill(rng, rng.choice(FURNITURE)) for _ in range(rng.randint(0, 5))]
        holder = rng.choice(HOLDERS).format(_content(rng))
        wrap = rng.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>'])
        pages.append("<html><head><title>t</title></head><body>" + wrap.format("".join([*before, holder, *after])) + "</body></html>")
    return pages
