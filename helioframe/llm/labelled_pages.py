"""Labelled pages: common layouts put together from hand-labelled parts.

``data-label`` marks an element and all below it as content or other; elements
without a mark above them (page frames, wrappers) are other.
"""

from __future__ import annotations

import random

_FILL = "morning river council stone paper report garden winter market voice letter engine teacher harbour music village answer summer road window".split()

FRAMES = [
    "<html><head><title>{t}</title><style>p{{margin:0}}</style></head><body>{top}{main}{bottom}</body></html>",
    "<html><body><div id='page'><div class='wrap'>{top}{main}{bottom}</div></div></body></html>",
    "<html><body>{top}<div class='container'><div class='row'>{main}{side}</div></div>{bottom}</body></html>",
    "<html><body>{top}<table><tr><td>{side}</td><td>{main}</td></tr></table>{bottom}</body></html>",
    "<body>{top}<div class='layout'>{side}<div class='column'>{main}</div></div>{bottom}</body>",
]
MAINS = [
    "<article data-label='content'><h1>{h}</h1>{body}</article>",
    "<article data-label='content'><header><h1>{h}</h1></header>{body}</article>",
    "<main><article data-label='content'><h1>{h}</h1><div class='entry-content'>{body}</div></article></main>",
    "<main><h1 data-label='content'>{h}</h1><div class='post-body' data-label='content'>{body}</div></main>",
    "<div class='content' data-label='content'><h1>{h}</h1>{body}</div>",
    "<div id='main-content'><div class='article-body' data-label='content'><h2>{h}</h2>{body}</div></div>",
    "<div class='post' data-label='content'><h1 class='title'>{h}</h1><div class='text'>{body}</div></div>",
    "<section class='story' data-label='content'><h1>{h}</h1>{body}</section>",
    "<div role='main' data-label='content'>{body}</div>",
    "<div data-label='content'><h1>{h}</h1>{body}</div>",
    "<div id='content' data-label='content'><h1>{h}</h1>{body}</div>",
    "<div id='main'><div class='entry' data-label='content'><h1>{h}</h1>{body}</div></div>",
    "<main data-label='content'><h1>{h}</h1>{body}</main>",
    "<div class='article' data-label='content'><h1>{h}</h1><p class='lead'>{s}</p>{body}</div>",
    "<article data-label='content'><h1>{h}</h1><p><b>{h}<br><p>{s}</p></article>",
    "<article data-label='content'><h1>{h}</h1><p>{w}</p></article>",
    "<article data-label='content'><p>{h}</p>{body}</article>",
]
BODIES = [
    "<p>{h}</p>", "<p>{w}</p>", "<p>{l}</p><p>{l}</p>", "{m}<br>{m}", "<p><strong>{w}</strong> {l}</p>", "<div><p>{l}</p><p>{s}</p></div>",
    "<p>{l}</p>", "<p>{m}</p>", "<p>{s}</p>", "<p>{l}<br><p>{m}", "<p><b>{m}</b></p>", "<h2>{h}</h2><p>{l}</p>", "<blockquote><p>{m}</p></blockquote>",
    "<ul><li>{s}</li><li>{m}</li></ul>", "<ol><li>{m}</li><li>{s}</li></ol>", "<figure><img src=x><figcaption>{s}</figcaption></figure>",
    "<pre>{m}</pre>", "<p>{m} <a href=x>{h}</a> {m}</p>", "<div>{l}</div>", "<table><tr><td>{s}</td><td>{h}</td></tr></table>", "<section><h3>{h}</h3><p>{m}</p></section>",
]
INSERTS = [  # parts that stand inside an article without belonging to it
    "<div class='ad' data-label='other'>{s}</div>", "<aside data-label='other'><h3>{h}</h3><p>{m}</p></aside>", "<div class='share' data-label='other'><a href=x>{w}</a> <a href=y>{w}</a></div>",
    "<div class='newsletter signup' data-label='other'><form><p>{s}</p><label>{w}</label><input name=e></form></div>", "<div class='related' data-label='other'><h4>{h}</h4><ul><li><a href=x>{h}</a></li><li><a href=x>{h}</a></li></ul></div>",
    "<div class='advertisement sponsored' data-label='other'><p>{m}</p></div>", "<nav class='toc' data-label='other'><ul><li><a href=x>{w}</a></li></ul></nav>", "<p class='promo' data-label='other'>{s}</p>",
]
TOPS = [
    "<nav><ul><li><a href=x>{w}</a></li><li><a href=y>{w}</a></li><li><a href=z>{w}</a></li></ul></nav>", "<header><div class='logo'>{w}</div><nav><a href=x>{w}</a> <a href=x>{w}</a></nav></header>",
    "<header class='site-header'><h1><a href=x>{h}</a></h1><p>{s}</p></header>", "<div id='menu'><ul><li><a href=x>{w}</a></li><li><a href=x>{w}</a></li></ul></div>", "<div class='cookie-notice banner'><p>{m}</p></div>",
    "<div class='ad'>{s}</div>", "<div class='notice'>{m}</div>", "<div class='breadcrumbs'><a href=x>{w}</a> / <a href=x>{w}</a></div>", "<form class='search'><label>{w}</label><input></form>", "<div class='alert' role='alert'>{s}</div>",
    "<div id='header'><h2>{h}</h2><p>{s}</p></div>", "<div role='banner'>{s}</div>", "<div class='topbar'>{s}</div>", "<ul class='menu nav'><li>{w}</li><li>{w}</li></ul>", "<div class='popup modal'><p>{m}</p></div>", "<div class='consent gdpr'><p>{l}</p></div>",
]
SIDES = [
    "<aside><h3>{h}</h3><p>{m}</p><ul><li><a href=x>{h}</a></li></ul></aside>", "<div class='sidebar'><h3>{h}</h3><p>{l}</p></div>", "<div id='sidebar'><div class='widget'><p>{m}</p></div></div>",
    "<aside class='ads'><p>{s}</p></aside>", "<div class='widget-area'><ul><li>{s}</li><li>{s}</li></ul></div>", "<div role='complementary'><p>{m}</p></div>", "",
]
BOTTOMS = [
    "<footer>&copy; {w} &middot; {s}</footer>", "<footer><p>{m}</p></footer>", "<div id='footer'><p>{s}</p><a href=x>{w}</a></div>", "<div class='comments'><h3>{w}</h3><div class='comment'><p>{l}</p></div><div class='comment'><p>{m}</p></div></div>",
    "<section id='comments'><ol class='comment-list'><li class='comment'><div class='comment-body'><p>{m}</p></div></li></ol><form id='respond'><p>{s}</p><textarea></textarea></form></section>", "<div class='related-posts'><h2>{h}</h2><ul><li><a href=x>{h}</a></li></ul></div>",
    "<ul class='reader-comments'><li>{l}</li><li>{m}</li></ul>", "<div class='reviews'><div class='review'><p>{l}</p></div></div>", "<form action=x><p>{m}</p><label>{s}</label></form>", "<div class='newsletter'><p>{m}</p></div>",
    "<div class='legal disclaimer'><p>{l}</p></div>", "<div class='ad advert'><p>{m}</p></div>", "<nav class='pagination'><a href=x>{w}</a></nav>", "<div role='contentinfo'><p>{m}</p></div>", "<div class='responses discussion'><article class='comment'><p>{l}</p></article></div>",
]


def _sentence(rng: random.Random, n: int) -> str:
    words = [rng.choice(_FILL) for _ in range(n)]
    for i in range(6, n - 3, 9):
        words[i] += rng.choice(",.")
    return (" ".join(words)).capitalize() + "."


def pages(count: int = 240, seed: int = 5) -> list[str]:
    rng = random.Random(seed)

    def fill(part: str) -> str:
        out = part.replace("{{", "{").replace("}}", "}") if "{t}" in part else part
        for key, low, high in (("{s}", 4, 12), ("{m}", 14, 40), ("{l}", 45, 160)):
            while key in out:
                out = out.replace(key, _sentence(rng, rng.randint(low, high)), 1)
        for key, low, high in (("{h}", 3, 9), ("{w}", 1, 2), ("{t}", 3, 6)):
            while key in out:
                out = out.replace(key, " ".join(rng.choice(_FILL) for _ in range(rng.randint(low, high))).capitalize(), 1)
        return out

    out = []
    for i in range(count):
        body = [fill(rng.choice(BODIES)) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.5:
            body.insert(rng.randint(0, len(body)), fill(rng.choice(INSERTS)))
        main = MAINS[i % len(MAINS)].replace("{body}", "".join(body))
        top = "".join(rng.sample(TOPS, rng.randint(1, 4)))
        bottom = "".join(rng.sample(BOTTOMS, rng.randint(1, 4)))
        frame = FRAMES[i % len(FRAMES)]
        page = frame.replace("{{", "{").replace("}}", "}").replace("{top}", top).replace("{main}", main).replace("{side}", rng.choice(SIDES)).replace("{bottom}", bottom)
        out.append(fill(page))
    return out
