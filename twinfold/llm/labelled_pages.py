"""Labelled pages: layouts with their main text marked, filled with sentences of varying length.

``data-label="main"`` or ``"other"`` holds for the text inside an element; the
extractor never sees the mark.  ``[s]`` is a short phrase, ``[t]`` a sentence,
``[p]`` a paragraph, ``[m]`` one to six paragraphs, ``[l]`` three to seven list
links.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fo ga he in jo ka le mo ne or pa qui ro sa ti un ve".split()

LAYOUTS = (
    '<html><head><title>[t]</title></head><body><nav><ul>[l]</ul></nav><div class="ad">[t]</div>'
    '<article data-label="main"><h1>[s]</h1>[m]</article><footer>&copy; [s] &middot; [t]</footer></body></html>',
    '<body><header><a href="/">[s]</a><p>[t]</p><nav><ul>[l]</ul></nav></header><main data-label="main"><h1>[t]</h1>[m]<h2>[s]</h2>[m]</main>'
    '<aside><h3>[s]</h3><p>[t]</p><ul>[l]</ul></aside><footer><p>[p]</p><p>[s]</p></footer></body>',
    '<body><div id="header"><h1>[s]</h1><div class="menu">[l]</div></div><div id="content" data-label="main"><h2>[s]</h2>[m]</div>'
    '<div id="sidebar"><h4>[s]</h4><p>[t]</p><p>[p]</p></div><div id="footer">[s] | [s] | [t]</div></body>',
    '<body><div class="cookie notice"><p>[p]</p><button>[s]</button></div><nav>[l]</nav><article data-label="main"><h1>[s]</h1><p class="lead">[p]</p>[m]'
    '<div class="advert" data-label="other"><p>[p]</p></div>[m]<section class="comments" data-label="other"><h3>[s]</h3><div class="comment"><p>[p]</p></div>'
    '<div class="comment"><p>[t]</p></div></section></article><footer><p>[t]</p></footer></body>',
    '<body><div class="topbar">[l]</div><div class="post" data-label="main"><h1 class="title">[t]</h1><div class="entry">[m]<ul><li>[t]</li><li>[t]</li></ul>[m]</div></div>'
    '<div id="comments"><h3>[s]</h3><ol><li><p>[p]</p></li><li><p>[p]</p><p>[t]</p></li></ol><form><label>[s]</label><textarea>[s]</textarea><input value="x">[s]</form></div>'
    '<div class="related"><h3>[s]</h3><ul>[l]</ul></div><div class="copyright">&copy; [s]</div></body>',
    '<body><table><tr><td class="nav">[l]</td><td class="content"><div data-label="main"><h2>[s]</h2>[m]<blockquote>[p]</blockquote>[m]</div></td><td class="ads"><p>[t]</p><p>[p]</p></td></tr></table>'
    '<p class="footer">[t]</p></body>',
    '<body><header class="site-header"><p>[s]</p><form action="/search"><label>[s]</label><button>[s]</button></form></header><div class="banner promo">[p]</div><main><article data-label="main">'
    '<h1>[s]</h1>[m]<pre>[p]</pre><ol><li>[p]</li><li>[t]</li></ol>[m]<aside class="newsletter" data-label="other"><p>[p]</p><form><input>[s]</form></aside>[m]</article></main>'
    '<div class="sidebar widget"><p>[p]</p>[l]</div><footer><ul>[l]</ul><p>[p]</p></footer></body>',
    '<body><nav class="breadcrumb"><ul>[l]</ul></nav><article data-label="main"><header><h1>[s]</h1></header><section>[m]</section><section><h2>[s]</h2>[m]</section>'
    '<footer data-label="other"><p>[t]</p><a href="#">[s]</a></footer></article><div id="disqus" class="reader-comments"><div class="reply"><p>[p]</p></div><div class="reply"><p>[p]</p></div></div>'
    '<div class="disclaimer notice">[p]</div></body>',
    '<body><div class="ad">[p]</div><article data-label="main"><h1>[s]</h1><p>[t]</p></article><div class="ad">[t]</div><footer>[s]</footer></body>',
    '<body><div role="banner" class="masthead">[s]</div><ul class="menu">[l]</ul><div role="main" class="story" data-label="main"><h1>[t]</h1>[m]<h3>[s]</h3>[m]<dl><dt>[s]</dt><dd>[p]</dd></dl></div>'
    '<div class="share social">[l]</div><div class="subscribe popup"><p>[t]</p></div><div role="contentinfo">[t]</div></body>',
    '<body data-label="main"><h1>[s]</h1>[m]</body>',
    '<p data-label="main">[p]</p>',
)


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentence(rng: random.Random) -> str:
    return _words(rng, rng.randint(3, 14)).capitalize() + rng.choice(".....!?")


def _fill(rng: random.Random, slot: str) -> str:
    if slot == "s":
        return _words(rng, rng.randint(1, 5)).capitalize()
    if slot == "t":
        return " ".join(_sentence(rng) for _ in range(rng.randint(1, 2)))
    if slot == "p":
        return " ".join(_sentence(rng) for _ in range(rng.randint(1, 9)))
    if slot == "m":
        ends = rng.choice(("</p>", ""))
        return "".join(f"<p>{rng.choice(('', '<b>', '<i>'))}{_fill(rng, 'p')}{rng.choice(('', '<br>'))}{ends}" for _ in range(rng.randint(1, 6)))
    return "".join(f'<li><a href="/x">{_fill(rng, "s")}</a></li>' for _ in range(rng.randint(3, 7)))


def labelled_pages(fillings: int = 12, seed: int = 7) -> list[str]:
    """Each layout with ``fillings`` different texts."""
    rng, out = random.Random(seed), []
    for _ in range(fillings):
        for layout in LAYOUTS:
            parts = layout.split("[")
            out.append(parts[0] + "".join(_fill(rng, x[0]) + x[2:] for x in parts[1:]))
    return out
