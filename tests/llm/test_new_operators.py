"""Conversation repair, hard negatives and the URL filter against brute force, with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from hindcast.llm import catalog, conversations, negatives, urls
from hindcast.llm.shipping import ship

# -- 11 ---------------------------------------------------------------------------------------------


def legal(roles):
    return re.fullmatch(r"(s?(ua)+)?", roles) is not None


def every_repair(rows):
    """Cheapest (cost, letters, repaired rows) by trying all edits, one insert at most in each gap."""
    best = None
    choices = []
    for role, text, gone, late in rows:
        own = [("D", 4, None)]
        if not gone:
            own += [("K", 3 * late, (role, text))] + [("R", 3 + 3 * late, (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    inserts = [("", 0, None), ("I", 3, ("user", "")), ("I", 3, ("assistant", ""))]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            way = [x for pair in zip(gaps, edits) for x in pair] + [gaps[-1]]
            kept = [x[2] for x in way if x[2]]
            if legal("".join(r[:1] or "-" for r, _ in kept)):
                found = (sum(x[1] for x in way), "".join(x[0] for x in way), kept)
                best = min(best, found) if best else found
    return best


def test_repair_is_the_cheapest_and_least(monkeypatch):
    dice = random.Random(3)
    for lot in (32, 1, 2):
        monkeypatch.setattr(conversations, "LOT", lot)
        for _ in range(60):
            rows = [(dice.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", dice.random() < 0.2, dice.random() < 0.3) for i in range(dice.randint(0, 4))]
            one = conversations.Repair()
            for role, text, gone, late in rows:
                one.add(8 if gone else "sua".find(role[:1] or "-") % 4 + 4 * late, role, text)
            cost, letters, kept = every_repair(rows)
            assert one.end() == (cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def test_a_lot_stands_for_any_length():
    dice = random.Random(5)
    rows = [(dice.choice([0, 1, 2, 3, 5, 6, 8]), ["system", "user", "assistant", "tool"][0], "") for _ in range(3000)]
    rows = [(k, "tool" if k == 8 else ["system", "user", "assistant", "tool"][k % 4], f"t{i}") for i, (k, _, _) in enumerate(rows)]
    one = conversations.Repair()
    for r in rows:
        one.add(*r)
    # One table over costs and letters as plain tuples.
    paths = {0: (0, "")}
    for kind, _, _ in rows:
        after = {}
        for state, (cost, letters) in paths.items():
            for to, more, digits, n in conversations.MOVES[state][kind]:
                text = "".join(conversations.LETTER[digits >> 3 * (n - 1 - i) & 7] for i in range(n))
                after[to] = min(after.get(to, (1 << 60, "")), (cost + more, letters + text))
        paths = after
    cost, letters = min((c + 3 * n, x + "I" * n) for s, (c, x) in paths.items() for n in ((0,) if s in (0, 3) else (1,) if s == 2 else (2,)))
    got = one.end()
    assert got[:2] == (cost, letters)
    assert got[2] == hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in conversations._edited(0, letters, rows)).encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, gaps string, alive int, kind double"


def damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if how:
            own += [(turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)] * (2 if how == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def summary(rows):
    counts, seen, out = [0, 0, 0], set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        out.append((role, text, fault in (1, 2), fault == 3))
    turns = [t for t, *_ in rows if t is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(out, out[1:]))
    cost, letters, kept = every_repair(out)
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()), [x for x in kept]


def test_repair_of_awkward_tables(spark):
    ship(spark)
    dice = random.Random(9)
    rows = []
    for conv in [None, -1, *range(40)]:
        for i in range(dice.randint(1, 4)):
            rows.append((conv, dice.choice([i, i, i, None, 7, -3]), dice.choice(["system", "user", "assistant", "assistant", None, "", "User"]), dice.choice(["Hi.", "No end", "", None, " \t\n ", "Hi.", "wo?  \n", "ünï 漢!"])))
    rows += [(50, -(1 << 63), "user", "a."), (50, (1 << 63) - 1, "assistant", "b."), (51, 0, "user", "long " * 300_000 + "."), (51, 1, "assistant", "y."), rows[0]]
    table = spark.createDataFrame([(*r, "x", 0, 1.0) for r in rows], TURNS).repartition(5)
    hurt = conversations.damage(table)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(hurt).collect()}
    want = {k: summary(v) for k, v in damaged(rows).items()}
    assert got == {k: v[0] for k, v in want.items()}
    turns = collections.defaultdict(list)
    for r in conversations.repaired(hurt, conversations.repair(hurt)).orderBy("place").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert turns == {k: v[1] for k, v in want.items() if v[1]}
    assert conversations.repair(conversations.damage(spark.createDataFrame([], TURNS))).count() == 0
    plain = conversations.repair(table.drop("alive")).where("conv_id = 51").first()
    assert (plain["cost"], plain["audit"]) == (0, "KK")


# -- 12 ---------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, q string, anchor_id int"


def mined(rows):
    known = {}
    for i, vector, label, *_ in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], r[1])):
        if all(x is not None and math.isfinite(x) for x in vector):
            known.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = set()
    for a, (label, q) in known.items():
        if a % 100:
            continue
        score = {b: min(max(sum(x * y for x, y in zip(q, p)), -(1 << 63)), (1 << 63) - 1) for b, (_, p) in known.items()}
        best = sorted(known, key=lambda b: (-score[b], b))
        for b in [b for b in best if b != a and known[b][0] == label][:5]:
            fits = [c for c in best if known[c][0] != label and 30 * score[b] <= 100 * score[c] <= 90 * score[b]][:10]
            out |= {(a, b, i + 1, c, score[b], score[c]) for i, c in enumerate(fits)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives_like_brute_force(spark, monkeypatch, small):
    ship(spark)
    rng = np.random.default_rng(2)
    if small:
        monkeypatch.setattr(negatives, "ANCHORS", 2)
        monkeypatch.setattr(negatives, "ROWS", 60)
    centre = rng.normal(size=10)
    rows = [(i, (rng.normal(size=10) * 0.3 + centre).round(2).tolist(), int(rng.integers(0, 3)), "x", 1) for i in range(-300, 400)]
    rows += [(1000 + i, rows[300][1], i % 2, None, None) for i in range(40)]  # one vector many times
    rows += [(2000, [None] * 10, 1, "", 0), (2001, [float("nan")] * 10, 1, "", 0), (2002, [float("inf")] * 10, 1, "", 0), (2100, None, 1, "", 0), (2200, [1.0] * 10, None, "", 0), (None, [1.0] * 10, 1, "", 0)]
    rows += [rows[5], (rows[9][0], rows[8][1], 2, "", 0), (3000, [], 1, "", 0), (3100, [0.5, 0.5], 1, "", 0)]
    got = [tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows)


def test_negatives_of_huge_components_and_nothing(spark):
    ship(spark)
    rows = [(i, [float(10 ** (i % 12)), 3.0e38 if i == 250 else -float(i)], i % 2, "", 0) for i in range(0, 300, 5)]
    assert {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()} == mined(rows)
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1, "", 0)], VECTORS)).count() == 0


def test_summaries_bound_every_product():
    rng = np.random.default_rng(4)
    for width in (1, 3, 16, 50):
        q = np.floor(256 * rng.normal(size=(80, width)))
        real = q @ q.T
        spreads = []
        for parts in negatives.LEVELS:
            means, devs = negatives.segments(q, parts)
            middle, spread = means @ means.T, devs @ devs.T
            assert (middle - spread <= real).all() and (real <= middle + spread).all()
            spreads.append(spread)
        assert (spreads[1] <= spreads[0] + 1e-6).all()


# -- 13 ---------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host int, rule string, blocked string"


def judged(rows, rules):
    def place(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        name = re.match(r"[^/?#]*", rest)[0]
        return name.translate(str.maketrans(urls.UPPER, urls.LOWER)), re.match(r"[^?#]*", rest[len(name):])[0]

    def rule(name, path):
        fits = [(-len(h + p), h, p, v) for h, p, v in rules if (name == h or name.endswith("." + h)) and path.startswith(p)]
        return (min(fits)[1] + min(fits)[2], min(fits)[3]) if fits else (None, None)

    pages, seeds, links = collections.Counter(), collections.Counter(), collections.Counter()
    for _, url, html in rows:
        name, path = place(url)
        pages[name] += 1
        seeds[name] += {"allow": 1, "block": -1, None: 0}[rule(name, path)[1]]
        for link in re.findall(urls.LINK, html or "", re.ASCII):
            to = re.match(r"[^/?#]*", link.split("//", 1)[1])[0].translate(str.maketrans(urls.UPPER, urls.LOWER))
            if name and to and name != to:
                links[name, to] += 1
    weight = {}
    for kind, sign in (("trust", 1), ("distrust", -1)):
        ways = {(a, b) if sign > 0 else (b, a): n for (a, b), n in links.items()}
        out = collections.Counter()
        for (a, _), n in ways.items():
            out[a] += n
        seed = {h: sign * n * urls.UNIT for h, n in seeds.items() if h and sign * n > 0}
        now = dict(seed)
        for _ in range(urls.ROUNDS):
            after = collections.Counter(seed)
            for (a, b), n in ways.items():
                after[b] += math.floor(now.get(a, 0) * (urls.DAMPING * n / out[a]))
            now = dict(after)
        weight[kind] = now
    got = collections.Counter()
    for i, url, _ in rows:
        name, path = place(url)
        own, verdict = rule(name, path)
        trust, distrust = (weight[k].get(name, 0) if name else 0 for k in ("trust", "distrust"))
        bad = name and distrust - trust >= urls.LEAST * urls.UNIT * pages[name]
        got[i, name, path, own, verdict or ("block" if bad else "allow"), trust / urls.UNIT, distrust / urls.UNIT] += 1
    return got


def test_urls_like_brute_force(spark):
    ship(spark)
    dice = random.Random(1)
    names = [f"{a}.example.{b}" for a in ("one", "two", "www.three", "Four") for b in ("com", "net", "org")] + ["net", "xnet", "example.net", "a.example.com:80"]
    rows = [(i, f"http{'s' * (i % 2)}://{dice.choice(names)}{dice.choice(['', '/', '/en/1', '/de/2?x=://y', '/fr/', '#top', '?q'])}", "".join(
        f"<a HREF = {q}{dice.choice(['http:', 'https:', ''])}//{dice.choice(names)}{dice.choice(['/x', '?y', ''])}{q}>" for q in dice.choices(['"', "'"], k=dice.randint(0, 4)))) for i in range(120)]
    rows += [(200, f"https://links.example.com/{i}", '<a href="http://one.example.net/">') for i in range(4)]  # only links to a blocked host
    rows += [(300, None, "<a href='//one.example.com'>"), (301, "no mark", None), (302, "", ""), (303, "://", "x"), (304, "a://b://c/d", None), (None, "http://two.example.org/fr/", None), (305, "x\ny://Q.net/\n/en/", "z" * 1_500_000), rows[0]]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES).repartition(3)
    got = collections.Counter(tuple(r) for r in urls.judge(table, urls.RULES).collect())
    assert got == judged(rows, urls.RULES)
    assert {r[4] for r in got if r[1] == "links.example.com"} == {"block"}
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0
    assert {r["verdict"] for r in urls.judge(table, []).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_hard_negatives", "op13_url_link_graph"])
def test_new_queries_equal_their_sql(spark, sf_dir, name):
    from check import canon, duck

    sf = sf_dir.replace("0.001", "0.01")
    df = catalog.load()[0][name](spark, sf)
    cur = duck(sf).execute(catalog.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())


def test_every_pair_of_copied_images_is_a_link(spark):
    from itertools import combinations

    from hindcast.llm import media

    rng = np.random.default_rng(21)
    greys = [media.drawn(v) for v in rng.normal(0, 0.125, (3, 64))]
    made = [(10 * i + j, media.write_pgm(np.clip(np.rint(g * (0.8 + 0.04 * j) + 3 * j), 0, 255).astype(np.uint8))) for i, g in enumerate(greys) for j in range(5)]
    read = {i: media.describe(media.read_pgm(c)[None])[0] for i, c in made}
    words = {i: set((d[1].astype(np.int64) + (np.arange(4) << 32)).ravel().tolist()) for i, d in read.items()}
    want = dict.fromkeys(read, 0)
    for b, a in combinations(sorted(read), 2):
        if len(words[a] & words[b]) >= media.SHARED and media.agreeing(read[a], read[b]) >= media.INLIERS:
            want[a] += 1
            want[b] += 1
    assert min(want.values()) >= 3
    got = media.copies(spark.createDataFrame(made, "image_id long, content binary")).collect()
    assert {r.image_id: r.n_links for r in got} == want
    assert {r.group_id for r in got} == {0, 10, 20}
