"""Trains the block labeller on generated texts: ``python -m stratagraph.llm.markup.train``.

Texts are made up of blocks of every kind of markup and of plain prose with the signs that prose and code have in
them, over random words, so the labeller learns signs and their context and no vocabulary. The seed fixes the result.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from . import lstm
from .leaves import BUCKETS, features, leaves

WEIGHTS = Path(__file__).with_name("weights.npz")
T, I, H, L, K, B, M, S = range(8)  # text, inline, heading, list, code, table, formula, syntax


class Maker:
    def __init__(self, rng: random.Random):
        self.r = rng

    def w(self) -> str:
        r = self.r
        if r.random() < 0.2:
            return r.choice("the a of to and in is for with be by on it that this Der die das und il la che non when until once".split())
        return "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))

    def words(self, a=1, z=5) -> str:
        return " ".join(self.w() for _ in range(self.r.randint(a, z)))

    def num(self) -> str:
        return str(self.r.randint(0, 999))

    def ident(self) -> str:
        r = self.r
        return r.choice([lambda: f"{self.w()}_{self.w()}", lambda: f"__{self.w()}_{self.w()}", lambda: f"{self.w()}_{self.w()}_max", lambda: f"x_{r.randint(0, 9)}", lambda: f"{self.w()}[{r.choice('ijkn')}]", lambda: f"{self.w()}()", lambda: f"{self.w()}->{self.w()}", lambda: f"{self.w()}.{self.w()}", lambda: f"{self.w()}::{self.w()}", lambda: f"_{self.w()}", lambda: f"*{self.w()}", lambda: f"&{self.w()}", lambda: f"__{self.w()}__", lambda: self.w().upper() + "_" + self.w().upper(), lambda: f"{self.w()}.h"])()

    def odd(self) -> str:
        """Signs that are no markup."""
        r, w, n = self.r, self.w, self.num
        return r.choice([
            lambda: f"{w()} < {w()} and {w()} - {w()} <= {n()}", lambda: f"{w()} > {w()}", lambda: f"({r.choice('abc')} > {r.choice('abc')})", lambda: f"{n()}^{n()} {w()}",
            lambda: f"{n()} * {w()} * {n()} / {n()}", lambda: f"about ${n()} of {w()}", lambda: f"${n()}.{n()} or ${n()}", lambda: f"{r.choice('CF')}# {w()}", lambda: f"#{n()} to #{n()}",
            lambda: f"{w()} & {w()}", lambda: self.ident(), lambda: f"reads {self.ident()} and {self.ident()}, then {self.ident()}", lambda: f"{w()} == {n()} || {w()} != {n()}", lambda: f"{w()} = {w()} + {n()};",
            lambda: f"({w()})", lambda: f"[{n()}]", lambda: f'"{w()}"', lambda: f"'{w()}'", lambda: f"{w()}/{w()}", lambda: f"{w()}-{w()}", lambda: f"{n()}%", lambda: f"~{n()} {w()}", lambda: f"{w()}: {w()}",
            lambda: f"{n()} {w()}/{w()}", lambda: f"{w()}'s", lambda: f"<= {n()}", lambda: f">= {n()}", lambda: f"{w()} << {n()}", lambda: f"{w()} -> {w()}", lambda: f"https://{w()}.org/{w()}_{w()}", lambda: f"{w()}@{w()}.com",
            lambda: f"{w()} | {w()}", lambda: f"0x{n()}", lambda: f"{w()} {{{w()}}}", lambda: f"C:\\{w()}\\{w()}", lambda: f"\\n", lambda: f"*{n()}", lambda: f"{w()}*", lambda: f"... {w()}", lambda: f"{w()} -- {w()}",
        ])()

    def sentence(self) -> str:
        r = self.r
        parts = [self.words(2, 9).capitalize()]
        while r.random() < 0.35:
            parts.append(self.odd())
            parts.append(self.words(1, 6))
        return " ".join(parts) + r.choice(["."] * 8 + ["!", "?", ";", ""])

    def plain(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 4)))

    def code_line(self) -> str:
        r, w = self.r, self.w
        return r.choice([lambda: f"int {w()} = {w()}_{w()}({w()});", lambda: f"{w()}_{w()}({w()}, {self.num()});", lambda: f"if ({w()} < {self.num()}) {{", lambda: "    return " + w() + ";", lambda: "}", lambda: f"{w()} = {w()} * {self.num()};", lambda: f"for i in range({self.num()}):", lambda: f"    print('{w()}')", lambda: f"return {w()};", lambda: f"# {self.words()}", lambda: f"{w()} --{w()} {w()}", lambda: f"$ {w()} {w()}", lambda: f"* {w()}", lambda: f"- {w()}: {w()}", lambda: f"{w()}: {self.num()}", lambda: self.words(1, 5), lambda: f"a[{w()}] += **{w()};", lambda: f"== {w()}"])()

    def inline(self) -> str:
        r, w, s = self.r, self.w, self.words
        return r.choice([
            lambda: f"**{s(1, 3)}**", lambda: f"*{s(1, 3)}*", lambda: f"__{s(1, 2)}__", lambda: f"_{s(1, 2)}_", lambda: f"~~{s(1, 4)} r{self.num()}~~", lambda: f"`{w()}_{w()}()`", lambda: f"`{w()}`", lambda: f"`{w()}()`", lambda: f"`{self.ident()}`", lambda: f"`{w()}.{w()}`", lambda: f"`-{w()}`", lambda: f"``{w()} {w()}``",
            lambda: f"[{s(1, 4)}](../{w()}/{w()}.md)", lambda: f"[{s(1, 3)}](https://{w()}.org)", lambda: f"[{s(1, 3)}][{w()}]", lambda: f"<https://{w()}.org/{w()}>",
            lambda: f"<b>{s(1, 3)}</b>", lambda: f"<i>{w()}</i>", lambda: f"<em>{s(1, 2)}</em>", lambda: f"<code>{w()}</code>", lambda: f'<a href="../{w()}/{w()}.html#{w()}">{s(1, 3)}</a>', lambda: "<br/>", lambda: "<br>", lambda: f"<span>{w()}</span>", lambda: f"H<sub>{r.randint(0, 9)}</sub>",
            lambda: f"{w()} &lt; {w()}", lambda: f"{w()} &amp;&amp; {w()}", lambda: f"&nbsp;&mdash; {w()}", lambda: f"{self.num()}&deg;C", lambda: f"&#{self.num()};", lambda: "&quot;" + w() + "&quot;", lambda: f"<!-- {s(1, 5)} -->",
            lambda: f"'''{s(1, 2)}'''", lambda: f"''{s(1, 2)}''", lambda: f"''({w()})''", lambda: f"[[{s(1, 2)}]]", lambda: f"[[{w()} {w()}|the {w()} {w()}]]", lambda: f"{{{{{w()}|{s(1, 4)}}}}}", lambda: f"<ref>{s(1, 4)}, {self.num()}</ref>", lambda: f"[http://{w()}.org {s(1, 2)}]",
            lambda: f"\\textbf{{{s(1, 2)}}}", lambda: f"\\emph{{{s(1, 2)}}}", lambda: f"\\footnote{{{self.sentence()}}}", lambda: f"See~\\ref{{sec:{w()}}}.", lambda: f"\\cite{{{w()}{self.num()}}}", lambda: f"\\texttt{{{w()}\\_{w()}}}", lambda: f"\\url{{{w()}.org}}", lambda: f"{w()}~\\cite{{{w()}}}", lambda: "\\LaTeX{}",
        ])()

    def formula(self) -> str:
        r, w = self.r, self.w
        v = r.choice("abcexyztn")
        return r.choice([lambda: f"{v}_{{k}} = \\frac{{x_{r.randint(0, 9)} - \\bar{{x}}}}{{\\sigma}}", lambda: f"{v}^2 + {r.choice('abc')}^2 = {self.num()}", lambda: f"t_{{{w()}}} = {self.num()} \\cdot \\sqrt{{n}}", lambda: f"\\sum_{{i=0}}^{{n}} {v}_i", lambda: f"{v} \\le {self.num()}", lambda: f"\\alpha + \\beta_{{{r.randint(0, 9)}}}", lambda: f"{v}_{r.randint(0, 9)}", lambda: f"O(n \\log n)"])()

    def with_inline(self, what) -> str:
        r = self.r
        s = what()
        return r.choice([lambda: f"{self.plain()} {s}", lambda: f"{s} {self.plain()}", lambda: f"{self.words(1, 6)} {s} {self.plain()}", lambda: f"{self.plain()} {self.words(1, 4)} {s}.", lambda: s + ": " + self.plain(), lambda: s])()

    def block(self) -> list[tuple[str, int]]:
        r, w, s = self.r, self.w, self.words
        k = r.random()
        if k < 0.34:
            return [(self.plain(), T) for _ in range(r.choice([1, 1, 1, 2, 3]))]
        if k < 0.36:
            return [(r.choice([s(1, 3), s(1, 3) + ":", w().capitalize() + "-" + w() + " " + w(), self.num() + " " + s(1, 3), r.choice("?-") , "...", "N/A", f"-- {s(2, 4)}", f"TODO: {s()}", f"({s(1, 3)})", f"{w()}()", "0123456789abcdef" * r.randint(2, 40), "x" * r.randint(10, 90)]), T)]
        if k < 0.38:
            return [(f"    {self.sentence()}", T)] if r.random() < 0.5 else [(f" * {self.sentence()}".replace(" * ", "  "), T)]
        if k < 0.395:  # a strong word in front of a sentence with names that have underscores
            return [(f"__{self.words(1, 2).capitalize()}__ {r.choice([self.sentence() + ' ', ''])}{self.w()} {self.ident()} {self.w()} {self.ident()}, {self.words(2, 6)}.", I)]
        if k < 0.50:
            return [(self.with_inline(self.inline), I) for _ in range(r.choice([1, 1, 2]))]
        if k < 0.54:
            return [(self.with_inline(lambda: f"${self.formula()}$"), M)]
        if k < 0.57:
            return r.choice([
                lambda: [(f"\\[ {self.formula()} \\]", M)], lambda: [("\\[", S), (self.formula(), M), ("\\]", S)], lambda: [(f"$${self.formula()}$$", M)], lambda: [("$$", S), (self.formula(), M), ("$$", S)],
                lambda: [("\\begin{equation}", S), (f"  {self.formula()}", M), ("\\end{equation}", S)], lambda: [(f"<math>{self.formula()}</math>", M)], lambda: [(f"\\({self.formula()}\\) {self.plain()}", M)],
            ])()
        if k < 0.67:
            title = r.choice([s(1, 4), f"{w()} {w()}", w().capitalize()])
            n = r.randint(1, 6)
            return r.choice([
                lambda: [("#" * n + " " + title, H)], lambda: [(title, H), (r.choice("=-") * r.randint(3, 16), S)], lambda: [(title, H), (r.choice("=-") * (len(title)), S)], lambda: [("=" * min(n + 1, 5) + f" {title} " + "=" * min(n + 1, 5), H)], lambda: [("=" * 2 + title + "=" * 2, H)],
                lambda: [(f"<h{n}>{title}</h{n}>", H)], lambda: [(f'<h{n} id="{w()}">{title}</h{n}>', H)], lambda: [(f"\\section{{{title}}}", H)], lambda: [(f"\\sub{'sub' * r.randint(0, 1)}section{{{title}}}", H)], lambda: [(f"\\chapter*{{{title}}}", H)], lambda: [(f"\\section{{{title}}}\\label{{sec:{w()}}}", H)],
            ])()
        if k < 0.78:
            n = r.randint(1, 4)
            item = lambda: r.choice([self.plain, self.sentence, lambda: f"**{w()}**: {self.sentence()}", lambda: f"*{w()}*: {self.sentence()}", lambda: self.with_inline(self.inline)])()
            tag = r.choice(["ul", "ol"])
            env = r.choice(["itemize", "enumerate", "description"])
            return r.choice([
                lambda: [("* " + r.choice(["**", "*"]).join(["", w(), ""]) + ": " + self.sentence(), L) for _ in range(n)], lambda: [("- " + item(), L) for _ in range(n + 1)], lambda: [("* " + item(), L) for _ in range(n + 1)], lambda: [(f"{i + 1}. " + item(), L) for i in range(n + 1)],
                lambda: [(f"<{tag}>", S), *[(f"<li>{item()}</li>", L) for _ in range(n)], (f"</{tag}>", S)], lambda: [(f"<li>{item()}</li>", L)], lambda: [(f"<li>{item()}", L) for _ in range(n)], lambda: [(f"<{tag}>", S), *[x for _ in range(n) for x in ((f"<li>{self.plain()}", L), (self.plain() + "</li>", L))], (f"</{tag}>", S)],
                lambda: [(f"\\begin{{{env}}}", S), *[(f"\\item {item()}", L) for _ in range(n)], (f"\\end{{{env}}}", S)], lambda: [(f"\\begin{{{env}}}", S), *[("  \\item " + item(), L) for _ in range(n)], (f"\\end{{{env}}}", S)], lambda: [("** " + item(), L), ("*** " + item(), L)], lambda: [("# " + item(), L), ("# " + item(), L), ("## " + item(), L)],
                lambda: [(f"\\item {item()}", L)], lambda: [("<dl>", S), (f"<dt>{w()}</dt><dd>{self.plain()}</dd>", L), ("</dl>", S)],
            ])()
        if k < 0.88:
            lines = [(self.code_line(), K) for _ in range(r.randint(1, 5))]
            f = r.choice(["```", "~~~", "````"])
            lang = r.choice(["", "", "c", "C", "python", "sh", "{.c}"])
            return r.choice([
                lambda: [(f + lang, S), *lines, (f, S)], lambda: [(f + lang, S), *lines, (f, S)], lambda: [("<pre><code>" + lines[0][0], K), *lines[1:], ("</code></pre>", S)], lambda: [("<pre>", S), *lines, ("</pre>", S)], lambda: [("<pre><code>" + lines[0][0] + "</code></pre>", K)],
                lambda: [("\\begin{verbatim}", S), *lines, ("\\end{verbatim}", S)], lambda: [("\\begin{lstlisting}[language=C]", S), *lines, ("\\end{lstlisting}", S)], lambda: [(f'<syntaxhighlight lang="{w()}">', S), *lines, ("</syntaxhighlight>", S)], lambda: [(f + lang, S), *lines],
            ])()
        if k < 0.96:
            c = r.randint(2, 4)
            cells = lambda: [r.choice([w, self.num, lambda: s(1, 2)])() for _ in range(c)]
            n = r.randint(1, 3)
            rule = [r.choice(["---", ":---:", ":---", "---:", "-----"]) for _ in range(c)]
            return r.choice([
                lambda: [("| " + " | ".join(cells()) + " |", B), ("|" + "|".join(rule) + "|", S), *[("| " + " | ".join(cells()) + " |", B) for _ in range(n)]], lambda: [(" | ".join(cells()), B), (" | ".join(rule), S), *[(" | ".join(cells()), B) for _ in range(n)]],
                lambda: [('{| class="wikitable"', S), ("! " + " !! ".join(cells()), B), *[x for _ in range(n) for x in (("|-", S), ("| " + " || ".join(cells()), B))], ("|}", S)], lambda: [("{|", S), ("|-", S), *[("| " + x, B) for x in cells()], ("|}", S)],
                lambda: [("<table><tr>" + "".join(f"<th>{x}</th>" for x in cells()) + "</tr>", B), *[("<tr>" + "".join(f"<td>{x}</td>" for x in cells()) + "</tr>", B) for _ in range(n - 1)], ("<tr>" + "".join(f"<td>{x}</td>" for x in cells()) + "</tr></table>", B)],
                lambda: [("<table>", S), *[("<tr>" + "".join(f"<td>{x}</td>" for x in cells()) + "</tr>", B) for _ in range(n)], ("</table>", S)], lambda: [("<table>", S), ("<tr>", S), *[(f"<td>{x}</td>", B) for x in cells()], ("</tr>", S), ("</table>", S)],
                lambda: [("\\begin{tabular}{" + "l" * c + "}", S), *[(" & ".join(cells()) + " \\\\", B) for _ in range(n)], ("\\end{tabular}", S)], lambda: [("\\begin{tabular}{" + "|c" * c + "|}", S), ("\\hline", S), *[(" & ".join(cells()) + " \\\\ \\hline", B) for _ in range(n)], ("\\end{tabular}", S)],
            ])()
        return r.choice([
            lambda: [(f"![{s(1, 3)}](img/{w()}.png)", I)], lambda: [(f"[[Category:{s(1, 2)}]]", S)], lambda: [(f"[[File:{w()}.png|thumb|{s(1, 3)}]]", I)], lambda: [(f"<!-- {s(1, 6)} -->", S)], lambda: [("<!--", S), (self.plain(), S), ("-->", S)], lambda: [(f"<p>{self.plain()}</p>", I)], lambda: [(f"<p>{self.plain()}", I), (f"{self.plain()}</p>", I)],
            lambda: [("<div>", S), (self.plain(), T), ("</div>", S)], lambda: [(f"{{{{{w()}|{self.plain()}}}}}", I)], lambda: [("> " + self.plain(), I) for _ in range(r.randint(1, 3))], lambda: [(f"<blockquote>{self.plain()}</blockquote>", I)], lambda: [(f"\\label{{sec:{w()}}}", S)], lambda: [("<hr/>", S)], lambda: [(f"\\usepackage{{{w()}}}", S)],
            lambda: [(f"<p>{self.with_inline(self.inline)}</p>", I)], lambda: [(f"[{w()}]: https://{w()}.org", S)], lambda: [("__TOC__", S)], lambda: [(f"<{r.choice(['b', 'i', 'p', 'small', 'div'])}>{self.plain()}", I)], lambda: [(f"\\begin{{center}}", S), (self.plain(), T), ("\\end{center}", S)],
        ])()

    def text(self) -> tuple[str, list[int]]:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4, 5, 6]))]
        rows: list[tuple[str, int]] = []
        for i, b in enumerate(blocks):
            if i and (r.random() < 0.55 or b[0][1] == H or (len(b) > 1 and b[1] == (b[1][0], S))):
                rows.append(("", -1))
            rows += b
        out, labels = [], []
        for line, label in rows:
            if line and not line.strip():
                continue
            out.append(line)
            if line.strip():
                labels.append(label)
        return "\n".join(out), labels


def train(steps: int = 5200, batch: int = 48, seed: int = 11, say=print) -> dict[str, np.ndarray]:
    rng = random.Random(seed)
    maker = Maker(rng)
    p = lstm.initial(BUCKETS)
    adam = lstm.Adam(p, 0.006)
    mean = 0.0
    for step in range(steps):
        sequences, labels = [], []
        while len(sequences) < batch:
            text, want = maker.text()
            if not want or len(leaves(text)) != len(want):
                continue
            sequences.append(features(text))
            labels += want
        adam.rate = 0.006 * min(1.0, 2.0 * (1 - step / steps)) + 1e-5
        loss, g = lstm.gradients(p, sequences, np.array(labels))
        adam.step(p, g)
        mean = 0.98 * mean + 0.02 * loss
        if step % 400 == 399:
            say(f"step {step + 1}: loss {mean:.4f}")
    return p


def held_out(p, n: int = 2000, seed: int = 99) -> tuple[float, float]:
    """Accuracy over leaves of texts the training never saw, and over texts for whether they have any markup."""
    maker = Maker(random.Random(seed))
    texts = [maker.text() for _ in range(n)]
    texts = [(t, w) for t, w in texts if w and len(leaves(t)) == len(w)]
    got = lstm.classify(p, [features(t) for t, _ in texts])
    leaf = [a == b for g, (_, w) in zip(got, texts) for a, b in zip(g, w)]
    whole = [bool((g != T).any()) == any(x != T for x in w) for g, (_, w) in zip(got, texts)]
    return sum(leaf) / len(leaf), sum(whole) / len(whole)


if __name__ == "__main__":
    weights = train(*(int(a) for a in sys.argv[1:2]))
    print("held out: leaves %.4f, texts %.4f" % held_out(weights))
    np.savez_compressed(WEIGHTS, **{k: v.astype("float16") for k, v in weights.items()})
