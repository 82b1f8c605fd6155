"""Labelled pages the extraction model is trained on.

Layouts of common kinds of page; ``y="1"`` begins main content, ``y="0"`` ends it for a subtree.
``#p`` stands for a paragraph's text, ``#s`` for a short one, ``#h`` for a heading, ``#w`` for a word.
"""

from __future__ import annotations

import random
import re

LAYOUTS = [
    # a news page with semantic tags
    '<html><body><header><a href="/">#w</a><p>#s</p></header><nav><ul><li><a href="#">#w</a></li><li><a href="#">#w</a></li>'
    '<li><a href="#">#w</a></li></ul></nav><main y="1"><article><h1>#h</h1><p>#p</p><p>#s</p><p>#p</p><h2>#h</h2><p>#p</p>'
    '<blockquote><p>#s</p></blockquote><p>#p <a href="#">#w</a> #s</p></article></main><aside y="0"><h3>#h</h3><ul><li><a href="#">#s</a></li>'
    '<li><a href="#">#s</a></li></ul><p>#p</p></aside><footer><p>#s</p><ul><li><a href="#">#w</a></li></ul>#s</footer></body></html>',
    # an article with adverts around and in it
    '<html><body><nav><ul><li><a href="#">#w</a></li><li><a href="#">#w</a></li></ul></nav><div class="ad">#s</div>'
    '<article y="1"><h1>#h</h1><p>#s</p><p>#p</p><div class="ad" y="0">#p</div><p>#p</p><p>#w</p><p>#p</p><aside y="0"><p>#s</p></aside><p>#p</p></article>'
    '<div class="ads banner">#p</div><footer>#s</footer></body></html>',
    # notices and a newsletter form
    '<html><body><div class="cookie-notice"><p>#p</p><button>#w</button></div><div id="header"><a href="#">#w</a> #s</div>'
    '<div id="content" y="1"><h1>#h</h1><p>#p</p><ul><li>#s</li><li>#s</li><li>#p</li></ul><p>#p</p><p>#s</p></div>'
    '<form><p>#s</p><label>#w</label><input></form><div class="newsletter signup"><p>#s</p></div><div id="footer"><p>#s</p></div></body></html>',
    # a blog post with reader comments
    '<html><body><div class="menu"><ul><li><a href="#">#w</a></li><li><a href="#">#w</a></li></ul></div><div class="post" y="1"><h2>#h</h2>'
    '<div class="entry-content"><p>#p</p><p>#p</p><pre>#s</pre><p>#s</p></div><div class="share social" y="0"><a href="#">#w</a><a href="#">#w</a></div></div>'
    '<section class="comments" id="comments"><h3>#h</h3><ol><li><div class="comment"><p>#s</p><p>#p</p></div></li><li><div class="comment"><p>#p</p></div></li></ol>'
    '<form><textarea></textarea></form></section><div class="sidebar widget"><h3>#h</h3><p>#s</p><ul><li><a href="#">#s</a></li></ul></div></body></html>',
    # comments inside the article
    '<html><body><header class="site-header"><h1>#w</h1><p>#s</p></header><article class="story" y="1"><header><h1>#h</h1><p>#s</p></header><section><p>#p</p><p>#p</p>'
    '<figure><figcaption>#s</figcaption></figure></section><section><h2>#h</h2><p>#p</p><table><tr><th>#w</th><td>#s</td></tr><tr><td>#w</td><td>#w</td></tr></table></section>'
    '<div class="comments" y="0"><p>#s</p><div class="comment"><p>#p</p></div><div class="comment"><p>#s</p></div></div><form y="0"><p>#s</p></form></article>'
    '<aside class="sidebar"><p>#p</p></aside><footer class="site-footer"><p>#s</p><p>#p</p></footer></body></html>',
    # plain divisions
    '<html><body><div class="nav"><a href="#">#w</a> <a href="#">#w</a> <a href="#">#w</a></div><div class="main" y="1"><h1>#h</h1><p>#p</p><p>#p</p><p>#s</p><div><p>#p</p></div></div>'
    '<div class="related"><h4>#h</h4><a href="#">#s</a><a href="#">#s</a></div><div class="footer">#s</div></body></html>',
    # roles
    '<html><body><div role="banner"><p>#s</p></div><div role="navigation"><a href="#">#w</a><a href="#">#w</a></div><div role="main" y="1"><h1>#h</h1><p>#p</p><p>#p</p><dl><dt>#w</dt><dd>#s</dd></dl></div>'
    '<div role="complementary"><p>#s</p><p>#p</p></div><div role="contentinfo"><p>#s</p></div><div role="dialog" class="modal popup"><p>#p</p></div></body></html>',
    # nearly bare
    '<html><body y="1"><h1>#h</h1><p>#p</p><p>#p</p><p>#p</p><p>#s</p></body></html>',
    '<html><body><article y="1"><p>#p</p><p>#p</p></article></body></html>',
    '<html><body><article y="1"><h1>#h</h1><p>#w</p><p>#s</p></article><footer>#s</footer></body></html>',
    # no telling names: the text itself shows where the content is
    '<div y="1"><h1>#h</h1><p>#p</p><p>#p</p></div>',
    '<html><body><div><a href="#">#w</a><a href="#">#w</a></div><div y="1"><h1>#h</h1><p>#p</p><p>#p</p><p>#p</p></div><div><a href="#">#w</a> <a href="#">#s</a></div></body></html>',
    '<html><body><table><tr><td><a href="#">#w</a></td><td y="1"><p>#p</p><p>#p</p><p>#s</p></td></tr></table></body></html>',
    '<html><body><div><div y="1"><h2>#h</h2><div>#p</div><div>#p</div><div>#s</div></div></div></body></html>',
    '<html><body y="1"><div><p>#p</p><p>#p</p></div><div><p>#p</p></div></body></html>',
    '<p y="1">#p</p><p y="1">#p</p>',
    # verse, lists and dialogue: content in many short pieces
    '<html><body><nav><a href="#">#w</a><a href="#">#w</a></nav><article y="1">' + "<p>#w</p>" * 30 + "<p>#s</p>" * 10 + '</article><footer>#s</footer></body></html>',
    '<html><body><main y="1"><h1>#h</h1><ul>' + "<li>#w</li>" * 15 + '</ul></main><aside><p>#p</p></aside></body></html>',
    # breadcrumbs, promotion, notice within main
    '<html><body><div class="breadcrumb"><a href="#">#w</a> <a href="#">#w</a></div><main y="1"><div class="notice alert" y="0"><p>#s</p></div><article><h1>#h</h1><p>#p</p><p>#p</p>'
    '<div class="promo sponsored" y="0"><p>#s</p><a href="#">#s</a></div><p>#p</p><nav y="0"><a href="#">#w</a><a href="#">#w</a></nav></article></main><div class="subscribe"><p>#s</p></div><footer><p>#p</p></footer></body></html>',
    '<html><body><ul class="menu"><li><a href="#">#w</a></li><li><a href="#">#w</a></li></ul><section class="article-body" y="1"><p>#p</p><p>#s</p><p>#p</p><ul><li>#s</li><li>#w</li></ul></section>'
    '<section class="advertisement"><p>#p</p></section><section id="sidebar"><p>#p</p></section></body></html>',
]
SYLLABLES = "ta ren lo mi sta ver und qui esta on der ti ca lu".split()


def labelled_pages(copies: int = 6, seed: int = 9) -> list[str]:
    """Each layout with several fillings."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(pick.randint(a, b))).capitalize()
    fill = {"p": lambda: ". ".join(words(4, 18) for _ in range(pick.randint(1, 6))) + ".",
            "s": lambda: words(1, 9), "h": lambda: words(2, 9), "w": lambda: words(1, 1)}
    return [re.sub(r"(?<!\")#([pshw])", lambda m: fill[m.group(1)](), layout) for layout in LAYOUTS for _ in range(copies)]
