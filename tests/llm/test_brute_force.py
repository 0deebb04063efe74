"""Mixture inference against a search of all mixtures, quotation links against plain loops, ties of language."""

import itertools
import random
import re

import numpy as np
import pytest
import regex

from noctule.llm import langid, quotes

# --- language mixtures -----------------------------------------------------------


def penalised(w, share, penalty):
    used = share > 0
    return np.log(w @ share).sum() - penalty * (used.sum() - 1) * np.log(len(w) + 1)


def searched(w, penalty, steps):
    """Best penalised log likelihood over all language sets and a grid of proportions."""
    languages = w.shape[1]
    best = max(penalised(w, np.eye(languages)[k], penalty) for k in range(languages))
    for size in range(2, languages + 1):
        for chosen in itertools.combinations(range(languages), size):
            for cut in itertools.combinations(range(1, steps), size - 1):
                share = np.zeros(languages)
                share[list(chosen)] = np.diff([0, *cut, steps]) / steps
                best = max(best, penalised(w, share, penalty))
    return best


@pytest.mark.parametrize("languages, steps", [(2, 200), (3, 40)])
@pytest.mark.parametrize("seed", range(12))
def test_mixtures_reach_the_best_penalised_likelihood(languages, steps, seed):
    rng = np.random.default_rng(100 * languages + seed)
    truth = rng.dirichlet(np.full(languages, 0.6), 3)
    sizes = [6, 40, 150]
    ll, owner = [], []
    for doc, (share, n) in enumerate(zip(truth, sizes)):
        spoken = rng.choice(languages, n, p=share)
        one = rng.normal(-14, 1.5, (n, languages))
        one[np.arange(n), spoken] += rng.normal(6, 3, n)
        ll.append(one)
        owner += [doc] * n
    pi, sure = langid.shares(np.concatenate(ll).astype("f4"), np.array(owner), 2.0)
    assert np.allclose(pi.sum(1), 1, atol=1e-4) and ((sure >= 0) & (sure <= 1 + 1e-9)).all()
    for doc, one in enumerate(ll):
        w = np.exp(one - one.max(1, keepdims=True))
        share = np.where(pi[doc] > 1e-12, pi[doc], 0)
        value, best = penalised(w, share / share.sum(), 2.0), searched(w, 2.0, steps)
        # twelve rounds of EM: within half a nat of the grid's best
        assert value >= best - 0.5, (doc, value, best, pi[doc])
        if sizes[doc] >= 40:
            kept = {k for k in range(languages) if pi[doc][k] > 0.15}
            assert {k for k in range(languages) if truth[doc][k] > 0.3} <= kept


def test_ties_between_languages(spark):
    docs = spark.createDataFrame([(1, "abc abd", "xx"), (2, "abc abd", "aa"), (3, "abc abd", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs, "text", "lang")
    out = langid.predict(docs, model).collect()
    assert {r["lang_pred"] for r in out} == {"aa"} and {round(r["score"], 6) for r in out} == {0.5}


# --- quotations --------------------------------------------------------------------

MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+")
WROTE = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$", re.I)
ENDED = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"'”’»)\]]))\s+")


def parsed(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        m = MARKS.match(line)
        out.append((m[0].count(">") if m else 0, line[m.end():] if m else line))
    return [x for i, x in enumerate(out) if not (x[0] == 0 and WROTE.match(x[1]) and i + 1 < len(out) and out[i + 1][0] > 0)]


def plain(passage):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", passage.lower()).strip()


def runs(lines, level):
    out, now = [], []
    for k, line in [*lines, (-1, "")]:
        if k == level:
            now.append(line)
        elif now:
            out.append(now)
            now = []
    return out


def spoken(lines, level):
    """Passages of a level with whether they are sentences only."""
    whole, parts = set(), set()
    for run in runs(lines, level):
        paragraphs = re.split(r"\n[ \t]*\n", "\n".join(run))
        whole |= {plain("\n".join(run)), *map(plain, paragraphs), *map(plain, run)}
        for piece in [*paragraphs, *run]:
            parts |= set(map(plain, ENDED.split(piece)))
    return {p: False for p in whole - {""}} | {p: True for p in parts - whole - {""}}


def brute_links(rows):
    out = {}
    threads = {t for t, o, _ in rows if t is not None and o is not None}
    for thread in threads:
        own = [(o, parsed(x)) for t, o, x in rows if t == thread and o is not None]
        first = {}
        for o, lines in own:
            for p in spoken(lines, 0):
                first[p] = min(first.get(p, o), o)
        parents, facts = {}, {}
        for o in {o for o, _ in own}:
            quoted = {}
            for lines in (x for k, x in own if k == o):
                for level in {k for k, _ in lines if k}:
                    for p, part in spoken(lines, level).items():
                        quoted[level, p] = quoted.get((level, p), True) and part
            links, weight = {}, {}
            for (level, p), part in quoted.items():
                at = first.get(p)
                if at is not None and at < o:
                    links[level, at] = links.get((level, at), 0) + 1
                    weight[level, at] = weight.get((level, at), 0) + len(p)
            top = [(level, part) for (level, _), part in quoted.items()]
            found = lambda keep: sum(1 for (level, p), part in quoted.items() if keep(level, part) and first.get(p, o) < o)  # noqa: E731, B023
            facts[o] = (sum(k == 1 and not part for k, part in top), found(lambda k, part: k == 1 and not part), len(top), found(lambda k, part: True),
                        [(level, at, n) for (level, at), n in sorted(links.items())])
            parents[o] = max(((-level, w, at) for (level, at), w in weight.items()), default=(None, None, None))[2]
        for o in parents:
            root, depth = o, 0
            while parents[root] is not None:
                root, depth = parents[root], depth + 1
            out[thread, o] = (parents[o], root, depth, *facts[o])
    return out


def threads(seed):
    rng = random.Random(seed)
    say = ["Yes.", "I think so, too.", "Thanks!", "What about Monday? It would suit me.", 'He said "no." Then he left.', "Ünïcode línes, also", "See below:", "One (two) three"]
    rows = []
    for thread in range(12):
        texts = []
        for turn in range(rng.randrange(2, 12)):
            lines = []
            for _ in range(rng.randrange(3)):
                source = rng.choice(texts) if texts else "nothing\nbefore"
                cut = source.split("\n")
                i = rng.randrange(len(cut))
                quoted = cut[i:i + rng.randrange(1, 4)]
                if rng.random() < 0.2:
                    quoted = [rng.choice(ENDED.split(quoted[0]))]
                if rng.random() < 0.15:
                    quoted = [x.upper() + "!" for x in quoted]
                if rng.random() < 0.3:
                    lines.append("On Monday, Bob wrote:")
                mark = rng.choice(["> ", ">", "> > ", " >> "])
                lines += [mark + x for x in quoted]
                lines += [rng.choice(["", f"own words {turn} of {thread}", rng.choice(say)])]
            lines += [rng.choice(say) for _ in range(rng.randrange(3))]
            texts.append("\n".join(lines))
            rows.append((thread, turn * 2, texts[-1]))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows + [(None, 1, "> Yes."), (3, None, "> Yes."), (50, 1, None), (50, 2, ""), (50, 3, "> \n>")]


@pytest.mark.parametrize("seed", range(4))
def test_quotations_equal_plain_loops(spark, seed):
    rows = threads(seed)
    got = {}
    for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect():
        if r["conv_id"] is not None and r["turn"] is not None:
            links = [(x["level"], x["original"], x["n"]) for x in r["links"]]
            got.setdefault((r["conv_id"], r["turn"]), set()).add(str((r["parent"], r["root"], r["reply_depth"], r["n_quoted"], r["n_linked"], r["n_all_quoted"], r["n_all_linked"], links)))
    want = {k: {str(v)} for k, v in brute_links(rows).items()}
    assert got == want
    assert sum("None" not in next(iter(v)) for v in want.values()) > 10
