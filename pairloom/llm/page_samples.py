"""Made-up web pages whose main text is known, to fit the block labeller on.

Blocks of the main text start with ``MARK``. A seed gives the same pages everywhere.
"""

from __future__ import annotations

import random

MARK = "⁣"

# Names under which pages keep what is not their main text, and what is said there.
NOISE_NAMES = {
    "nav": "nav menu navbar navigation main-menu topbar breadcrumb breadcrumbs pagination toc links",
    "ad": "ad ads advert advertisement sponsored promo promotion banner ad-slot adsense teaser",
    "notice": "cookie cookies cookie-notice consent gdpr notice notification alert popup modal overlay",
    "side": "sidebar side widget widgets related related-posts recommended more-stories popular trending tags",
    "social": "share social sharing share-buttons follow like-box",
    "form": "newsletter subscribe signup search search-form login login-form contact-form",
    "comment": "comments comment comment-list discussion responses reply replies reader-comments respond",
    "foot": "footer site-footer copyright legal bottom colophon credits imprint",
    "head": "header site-header masthead branding logo site-title tagline",
}
MAIN_NAMES = "content post post-content entry entry-content article article-body story story-body main main-content text body-text page-content"
NOISE_WORDS = {
    "nav": "home about contact menu next previous back archive categories news sports",
    "ad": "buy now sale offer free shipping discount shop deal sponsored advertisement",
    "notice": "we use cookies accept settings privacy policy agree experience consent",
    "side": "related more popular recommended read latest tags also trending stories",
    "social": "share tweet facebook email print follow us like",
    "form": "subscribe email address search log in password sign up newsletter submit",
    "comment": "reply comments posted by says ago report thanks great agree",
    "foot": "copyright all rights reserved terms privacy imprint contact powered",
    "head": "welcome daily times blog magazine online",
}
_SOUNDS = "th er an in re on at en nd ti es or te of ed is it al ar st to nt ng se ha ou le de la el que ment tion ein sch ich und ver ung ción ado os as aux eux oi é è ê ç ñ ó í ü ä ö ß".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.words = ["".join(rng.choices(_SOUNDS, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(rng.randint(30, 150))]

    def sentence(self, most: int = 14) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(1, most))
        mark = self.rng.choice((".", ".", ".", ".", "?", "!", "", "&amp;&amp;", "%%", "***"))
        return " ".join(words).capitalize() + mark

    def prose(self, most: int = 6) -> str:
        out = []
        for _ in range(self.rng.randint(1, most)):
            text = self.sentence()
            if self.rng.random() < 0.15:
                text = self.rng.choice(("<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}</em> &mdash;", "<b>{}<br>", "<span>{}</span>")).format(text)
            out.append(text)
        return self.rng.choice((" ", " ", "\n")).join(out)

    def named(self, kind: str, tag: str | None = None) -> tuple[str, str]:
        """An opening tag that gives its kind away by tag, class or id, and its closing tag."""
        name = self.rng.choice((NOISE_NAMES[kind] if kind in NOISE_NAMES else kind).split())
        tag = tag or self.rng.choice(("div", "div", "section", "aside"))
        how = self.rng.choice(('class="{}"', 'id="{}"', 'class="x {}"', 'class="{}" role="region"'))
        return f"<{tag} {how.format(name)}>", f"</{tag}>"

    def noise_text(self, kind: str) -> str:
        if self.rng.random() < 0.4:
            return " ".join(self.rng.choices(NOISE_WORDS[kind].split(), k=self.rng.randint(1, 6))).capitalize()
        return self.prose(3) if self.rng.random() < 0.6 else self.sentence(3)

    def links(self, kind: str) -> str:
        items = "".join(f'<li><a href="/{i}">{self.noise_text(kind) if self.rng.random() < 0.3 else self.rng.choice(self.words)}</a></li>' for i in range(self.rng.randint(2, 8)))
        return f"<ul>{items}</ul>" if self.rng.random() < 0.8 else items.replace("<li>", " ").replace("</li>", " | ")

    def noise(self, kind: str) -> str:
        r = self.rng
        if kind == "nav":
            start, end = ("<nav>", "</nav>") if r.random() < 0.5 else self.named("nav")
            return start + self.links(kind) + end
        if kind == "foot":
            start, end = ("<footer>", "</footer>") if r.random() < 0.6 else self.named("foot")
            inner = f"&copy; {r.choice(self.words)}.example &middot; {self.prose(2)}" if r.random() < 0.6 else f"<p>{self.noise_text(kind)}</p>" + self.links("nav")
            return start + inner + end
        if kind == "head":
            start, end = ("<header>", "</header>") if r.random() < 0.6 else self.named("head")
            return start + r.choice(("<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "{}")).format(self.noise_text(kind)) + end
        if kind == "form":
            start, end = ('<form action="/s">', "</form>") if r.random() < 0.6 else self.named("form")
            return f'{start}<label>{self.noise_text(kind)}</label><input type="text"><button>{self.noise_text(kind)}</button>{end}'
        if kind == "comment":
            start, end = self.named("comment")
            each = "".join(r.choice(("<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<li>{}</li>")).format(self.prose()) for _ in range(r.randint(1, 5)))
            return f"{start}<h3>{self.noise_text(kind)}</h3>{each}{end}"
        start, end = ("<aside>", "</aside>") if kind == "side" and r.random() < 0.5 else self.named(kind)
        inner = self.links(kind) if kind in ("side", "social") and r.random() < 0.6 else r.choice(("{}", "<p>{}</p>", "<p>{}</p><p>{}</p>")).replace("{}", self.noise_text(kind))
        return start + inner + end

    def main_block(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.7:
            return r.choice(("<p>{}{}</p>", "<p>{}{}</p>", "<p>{}{}</p>", "<p>{}{}", "<p><b>{}{}<br>")).format(MARK, self.prose())
        if kind < 0.8:
            return r.choice(("<h2>{}{}</h2>", "<h3>{}{}</h3>")).format(MARK, self.sentence(6))
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{MARK}{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.94:
            return r.choice(("<blockquote>{}{}</blockquote>", "<pre>{}{}</pre>", "<blockquote><p>{}{}</p></blockquote>", "<div>{}{}</div>")).format(MARK, self.prose())
        return "<table>" + "".join(f"<tr><td>{MARK}{self.sentence(4)}</td><td>{MARK}{self.sentence(4)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"

    def article(self) -> str:
        r = self.rng
        blocks = [f"<h1>{MARK}{self.sentence(8)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 10))):
            blocks.append(self.main_block())
            if r.random() < 0.08:
                blocks.append(self.noise(r.choice(("ad", "side", "social", "form", "notice"))))
        if r.random() < 0.2:
            blocks.append(self.noise(r.choice(("social", "side", "comment"))))
        inner = "".join(blocks)
        how = r.random()
        if how < 0.4:
            return f"<article>{inner}</article>"
        if how < 0.55:
            return f"<main>{inner}</main>"
        if how < 0.65:
            return f"<main><article>{inner}</article></main>"
        if how < 0.93:
            start, end = self.named(MAIN_NAMES, r.choice(("div", "div", "section", "td")))
            return start + inner + end
        return inner

    def page(self) -> str:
        r = self.rng
        before = [k for k in ("head", "nav", "ad", "notice", "form", "nav") if r.random() < 0.5]
        after = [k for k in ("comment", "side", "social", "ad", "foot", "notice") if r.random() < 0.45]
        r.shuffle(before)
        title = self.sentence(8)
        start = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>'
        parts = [self.noise(k) for k in before] + ["<!-- x -->" * (r.random() < 0.5)] + [self.article()] + [self.noise(k) for k in after]
        if r.random() < 0.3:
            parts.insert(r.randrange(len(parts)), '<script>var t = "</p>";</script>')
        return start + "".join(parts) + ("</body></html>" if r.random() < 0.8 else "")


def sample_pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
