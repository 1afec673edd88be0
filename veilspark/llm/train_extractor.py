"""Train the block labeller on generated pages: python -m veilspark.llm.train_extractor

The pages are made up here: invented words in random layouts, with the main text in one of many containers among menus,
headers, footers, sidebars, notices, adverts, forms and comments, with and without telling names.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from veilspark.llm.html_blocks import blocks
from veilspark.llm.html_lstm import Features, gradients, new_weights, probabilities

MAIN, REST = "⁠", "⁡"  # invisible marks at the start of a block say what it is; they are removed before training
ARTICLES = ["<article>|</article>", '<article class="post">|</article>', "<main>|</main>", '<main id="content"><article>|</article></main>', '<div class="article-body">|</div>', '<div id="content">|</div>', '<div class="entry-content">|</div>', '<section class="story">|</section>', '<div class="post-content" itemprop="articleBody">|</div>', "<div>|</div>", '<div class="text">|</div>', '<td valign="top">|</td>', '<div role="main">|</div>']
MENUS = ["<nav>|</nav>", '<div class="menu">|</div>', '<ul id="navigation">|</ul>', '<div role="navigation">|</div>', '<div class="breadcrumb">|</div>', "<header>|</header>", '<div id="topbar">|</div>', '<div class="pagination">|</div>', '<div class="tags">|</div>', '<div class="share social">|</div>', "<div>|</div>"]
ASIDES = ["<aside>|</aside>", '<div class="sidebar">|</div>', '<div id="right-column" class="widget">|</div>', '<section class="related">|</section>', '<div class="recommended">|</div>', '<div class="popular">|</div>']
ADS = ['<div class="ad">|</div>', '<div class="ads banner">|</div>', '<div class="sponsored">|</div>', '<aside class="promo">|</aside>', '<div class="advert">|</div>', '<div class="advertisement">|</div>', '<section class="newsletter">|</section>']
NOTICES = ['<div class="cookie-notice">|</div>', '<div id="cookie-banner" role="dialog">|</div>', '<div class="notice">|</div>', '<div class="alert" role="alert">|</div>', '<div class="gdpr consent">|</div>', '<div class="paywall">|</div>', '<div class="popup modal">|</div>']
FOOTERS = ["<footer>|</footer>", '<div id="footer">|</div>', '<div class="copyright">|</div>', '<div class="site-footer legal">|</div>', "<footer><div>|</div></footer>"]
COMMENTS = ['<section class="comments">|</section>', '<div id="comments">|</div>', '<ol class="comment-list">|</ol>', '<div class="comment-thread" id="disqus">|</div>', '<div class="reader-comments">|</div>', '<div class="responses replies">|</div>']
FORMS = ["<form>|</form>", '<form class="search">|</form>', '<form id="login">|</form>', '<div class="form"><form action="/s">|</form></div>']
SAID = {
    "notice": ["We use cookies to improve your experience.", "Accept all", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Utilizamos cookies.", "Sign in to continue reading.", "Please enable JavaScript."],
    "ad": ["Advertisement", "Buy now and save 50% today!", "Sponsored content", "Anzeige", "Publicité", "Publicidad", "Subscribe to our newsletter"],
    "footer": ["© 2024 All rights reserved.", "Terms of use | Privacy policy", "Impressum · Datenschutz", "Mentions légales", "Contact us", "© {w} · {w} {w} {w}."],
    "comment": ["Great post, thanks!", "Reply", "posted 3 hours ago", "User42 says:", "I don't agree with this at all.", "Antworten", "Répondre", "+1"],
    "form": ["Search", "Your e-mail address", "Password", "Log in", "Send", "Suchen", "Chercher", "Enviar"],
    "aside": ["Related articles", "Most read", "You may also like", "Popular posts", "Follow us", "Latest news"],
    "menu": ["Home", "About", "News", "Contact", "Sport", "Start", "Accueil", "Inicio", "Next page", "Share on"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(["the", "an", "er", "in", "on", "st", "th", "le", "eau", "é", "ung", "ch", "ver", "ción", "os", "a", "ra", "mi", "tu", "ko", "be"]) for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else self.r.choice(["%%%", "!!", "&amp;"]) if self.r.random() < 0.01 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def text(self, kind: str) -> str:
        if self.r.random() < 0.5:
            return self.r.choice(SAID[kind]).replace("{w}", self.word())
        return self.sentence(1, 14 if kind != "comment" else 40)

    def inner(self, kind: str, n: int) -> str:
        r, out = self.r, []
        for _ in range(n):
            t = REST + self.text(kind)
            if kind in ("menu", "aside") and r.random() < 0.8:
                t = f'<a href="/{self.word()}">{REST}{" ".join(self.word() for _ in range(r.randint(1, 3 if kind == "menu" else 9)))}</a>'
            out.append({"form": f"<label>{t}</label><input><br>", "comment": f"<p>{t}</p>"}.get(kind) or r.choice(["<li>|</li>", "<li>|</li>", "<p>|</p>", "<div>|</div>"]).replace("|", t))
        body = "".join(out)
        return f"<ul>{body}</ul>" if "<li>" in body and r.random() < 0.8 else body

    def box(self, kind: str, kinds: list[str], n: int) -> str:
        bare = self.r.random() < 0.12
        shape = self.r.choice(kinds) if not bare else "<div>|</div>"
        inner = self.inner(kind, n) if n > 1 or self.r.random() < 0.3 else REST + self.text(kind)
        return shape.replace("|", inner)

    def odd(self) -> str:
        """Text that an article may hold although it doesn't look like prose."""
        r, n = self.r, self.r.randint(1, 40)
        words = [self.word() for _ in range(n)]
        return r.choice(
            [
                " | ".join(words),
                " ".join([words[0]] * n),
                " ".join(w.upper() + "!!" for w in words),
                " ".join(w + r.choice(["%%%", "###", "$$$", "***", "&amp;&amp;&amp;"]) for w in words),
                " ".join(str(r.randint(0, 10**r.randint(1, 12))) for _ in words),
                "".join(r.choice("0123456789abcdef") for _ in range(n * 4)),
                f"Copyright © {r.randint(1990, 2030)} {words[0]}. All rights reserved.",
                "Licensed under the Apache License, Version 2.0.",
                f"{words[0]}@{words[-1]}.com +1 (555) 010-2030 https://{words[0]}.org/{words[-1]}",
                r.choice([x for kind in ("comment", "aside", "ad") for x in SAID[kind]]),
                words[0],
                ", ".join(words),
            ]
        )

    def article(self) -> str:
        r, out = self.r, []
        strange = r.choice([0, 0, 0, 0.1, 0.5, 1])
        if r.random() < 0.85:
            out.append(f"<h1>{MAIN}{self.odd() if r.random() < strange else self.sentence(2, 10)}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            t = MAIN + (self.odd() if r.random() < strange else " ".join(self.sentence(1 if r.random() < 0.1 else 3) for _ in range(r.choice([1, 1, 2, 4, 9]))))
            x = r.random()
            if x < 0.1:
                out.append(f"<h{r.randint(2, 4)}>{MAIN}{self.sentence(1, 6)}</h2>")
            elif x < 0.2:
                out.append(f"<p><b>{t}<br><p>")
            elif x < 0.27:
                out.append("<ul>" + "".join(f"<li>{MAIN}{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.33:
                out.append(f"<blockquote>{t}</blockquote>")
            elif x < 0.4:
                half = t.split(" ")
                out.append("<p>" + " ".join(half[: len(half) // 2]) + f' <a href="/x">{self.word()}</a> ' + " ".join(half[len(half) // 2 :]) + "</p>")
            elif x < 0.45:
                out.append(f"<div>{t}</div>")
            else:
                out.append(f"<p>{t}</p>")
            if r.random() < 0.05:
                out.append(self.box("ad", ADS, 1))
        if r.random() < 0.15:
            out.append(self.box("comment", COMMENTS, r.randint(1, 6)))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        top = [self.box("menu", MENUS, r.choice([2, 4, 6, 12])) if r.random() < 0.9 else "", self.box("notice", NOTICES, r.randint(1, 2)) if r.random() < 0.3 else "", self.box("ad", ADS, 1) if r.random() < 0.5 else "", self.box("form", FORMS, r.randint(1, 3)) if r.random() < 0.25 else "", self.box("aside", ASIDES, r.randint(2, 6)) if r.random() < 0.2 else "", f"<header>{REST}{self.sentence(1, 6)}</header>" if r.random() < 0.2 else ""]
        low = [self.box("aside", ASIDES, r.randint(2, 8)) if r.random() < 0.4 else "", self.box("comment", COMMENTS, r.randint(1, 8)) if r.random() < 0.35 else "", self.box("ad", ADS, 1) if r.random() < 0.25 else "", self.box("form", FORMS, r.randint(1, 3)) if r.random() < 0.15 else "", self.box("notice", NOTICES, 1) if r.random() < 0.15 else ""]
        r.shuffle(top)
        r.shuffle(low)
        foot = self.box("footer", FOOTERS, r.randint(1, 3)) if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{''.join(top)}{r.choice(ARTICLES).replace('|', self.article())}{''.join(low)}{foot}</body></html>"


def labelled(pages: list[str]) -> tuple[Features, np.ndarray]:
    parsed, y = [], []
    for html in pages:
        own = []
        for b in blocks(html):
            y.append(1 if MAIN in b.text else 0)
            b.text = b.text.replace(MAIN, "").replace(REST, "") or "-"
            own.append(b)
        parsed.append(own)
    return Features(parsed), np.array(y, dtype=np.float32)


def accuracy(w: dict[str, np.ndarray], pages: list[str]) -> float:
    f, y = labelled(pages)
    return float(((probabilities(w, f) > 0.5) == (y == 1)).mean())


def train(pages: int = 5000, rounds: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    maker, rng = Maker(seed), np.random.default_rng(seed)
    made, w = [maker.page() for _ in range(pages)], new_weights(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    total = rounds * -(-pages // batch)
    for _ in range(rounds):
        order = rng.permutation(pages)
        for k in range(0, pages, batch):
            f, y = labelled([made[i] for i in order[k : k + batch]])
            _, g = gradients(w, f, y)
            step += 1
            for name in w:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                lr = rate * (1 - step / (total + 1))
                w[name] = (w[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return w


if __name__ == "__main__":
    weights = train()
    held_out = [Maker(1_000_003).page() for _ in range(1)] + [Maker(2_000_000 + i).page() for i in range(500)]
    print(f"held-out accuracy by block: {accuracy(weights, held_out):.4f}")
    np.savez_compressed(Path(__file__).with_name("extractor.npz"), **{k: x.astype(np.float16) for k, x in weights.items()})
