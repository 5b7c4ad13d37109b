"""Plain Python versions of the operators' contracts, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def components(ids, links):
    reach = {i: {i} for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            both = reach[a] | reach[b]
            for x in both:
                if reach[x] != both:
                    reach[x], changed = both, True
    return {i: min(r) for i, r in reach.items()}
