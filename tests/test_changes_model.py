"""Changes of facts against a plain model, on random sides."""

import random
from collections import Counter, defaultdict

from lakeloom.functions.text import python_tokens
from lakeloom.operators.facts import changes

FACT = "grp string, value string, normalized string, state string, signature string, pos long"


def model(before, after):
    out = []
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(sides, (before, after)):
        for r in sorted(rows, key=lambda r: r[5]):
            side[r[0]].append(r)
    for g in set(sides[0]) | set(sides[1]):
        left, right = sides[0][g], sides[1][g]
        common = Counter(r[2:4] for r in left) & Counter(r[2:4] for r in right)

        def rest(rows):
            due, kept = Counter(common), []
            for r in rows:
                if due[r[2:4]] > 0:
                    due[r[2:4]] -= 1
                else:
                    kept.append(r)
            return kept

        left, right = rest(left[::-1])[::-1], rest(right)
        one = [Counter(r[4] for r in side) for side in (left, right)]
        both = [s for s in one[0] if one[0][s] == 1 == one[1].get(s)]
        for s in both:
            a, b = next(r for r in left if r[4] == s), next(r for r in right if r[4] == s)
            out.append((g, a[1], b[1], "signature"))
        left, right = [r for r in left if r[4] not in both], [r for r in right if r[4] not in both]
        if len(left) == len(right) == 1:
            x, y = set(python_tokens(left[0][1])), set(python_tokens(right[0][1]))
            if len(x & y) / max(1, len(x | y)) >= 0.35:
                out.append((g, left[0][1], right[0][1], "alike"))
                continue
        out += [(g, r[1], None, "removed") for r in left] + [(g, None, r[1], "added") for r in right]
    return out


def test_changes_against_the_model(spark):
    r = random.Random(11)

    def side():
        rows = []
        for g in range(60):
            for i in range(r.randrange(5)):
                words = r.choice(["pro plan ten", "pro plan twelve", "team plan", "free", "other words here"])
                rows.append((f"g{g}", f"{words} {r.randrange(3)}", words, r.choice(["", "x"]), words.split()[0], len(rows)))
        return rows

    before, after = side(), side()
    a, b = (spark.createDataFrame(x, FACT) for x in (before, after))
    got = Counter((x.grp, x.before_value, x.after_value, x.how) for x in changes(a, b).collect())
    assert got == Counter(model(before, after)) and len(got) > 50
    assert changes(a, a).count() == 0 and changes(a, b.limit(0)).count() == len(before)
    back = Counter({"added": "removed", "removed": "added"}.get(x.how, x.how) for x in changes(b, a).collect())
    assert back == Counter(x[3] for x in model(before, after))
