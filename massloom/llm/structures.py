"""A code for the connectivity of a structure that doesn't depend on how the structure is written.

The helper reads one line notation at a time; Spark hands it the distinct notations only.
"""

from __future__ import annotations

import re
from hashlib import blake2b

# The tokens of the line notation.
TOKEN = re.compile(r"(\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops*]|%\d\d|\d|[-=#$:/\\~.()])")
BRACKET = re.compile(r"^\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)[^\]]*\]$")
BOND = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1, "~": 1}


def read_graph(notation: str) -> tuple[list[str], list[tuple[int, int, int]], list[int]] | None:
    """Atoms, bonds (two atoms and an order) and the fragment of each atom; None if the notation can't be read."""
    atoms, bonds, fragment = [], [], []
    stack, rings = [], {}
    last, order, part, at = -1, 0, 0, 0
    for m in TOKEN.finditer(notation):
        if m.start() != at:
            return None
        at, t = m.end(), m.group()
        if t == "(":
            stack.append(last)
        elif t == ")":
            if not stack:
                return None
            last = stack.pop()
        elif t == ".":
            last, order, part = -1, 0, part + 1
        elif t in BOND:
            order = BOND[t]
        elif t[0] == "%" or t.isdigit():
            if last < 0:
                return None
            if t in rings:
                other, o = rings.pop(t)
                bonds.append((other, last, order or o))
            else:
                rings[t] = (last, order)
            order = 0
        else:
            if t[0] == "[":
                b = BRACKET.match(t)
                if not b:
                    return None
                t = b.group(1)
            if t == "H":
                continue
            atoms.append(t)
            fragment.append(part)
            if last >= 0:
                bonds.append((last, len(atoms) - 1, order))
            last, order = len(atoms) - 1, 0
    if at != len(notation) or stack or rings or not atoms:
        return None
    # A single bond may be written or not, also between two aromatic atoms: it is one kind.
    return atoms, [(a, b, o if o > 1 else 1) for a, b, o in bonds], fragment


#: Orderings of one ring system that are looked at; beyond (very symmetric cages) it is told by its atoms, one more singled out at a time.
MOST_ORDERINGS = 512

Near = dict[int, list[tuple[int, int]]]


def refined(color: dict[int, int], near: Near) -> dict[int, int]:
    """Colours told apart by the colours around them until nothing changes; equal graphs get equal numbers."""
    kinds = len(set(color.values()))
    while True:
        sign = {i: (c, tuple(sorted([(color[j], o) for j, o in near[i]]))) for i, c in color.items()}
        number = {k: n for n, k in enumerate(sorted(set(sign.values())))}
        color = {i: number[x] for i, x in sign.items()}
        if len(number) == kinds:
            return color
        kinds = len(number)


def ring_systems(near: Near) -> list[list[int]]:
    """The sets of more than one atom that stay connected whichever bond is cut."""
    order, low, systems = {}, {}, []
    for start in near:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        path, open_atoms = [(start, -1, iter(near[start]))], [start]
        while path:
            i, came, rest = path[-1]
            for j, _ in rest:
                if j == came:
                    came = -1  # the bond back, once
                    path[-1] = (i, came, rest)
                elif j in order:
                    low[i] = min(low[i], order[j])
                else:
                    order[j] = low[j] = len(order)
                    open_atoms.append(j)
                    path.append((j, i, iter(near[j])))
                    break
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[i])
                if low[i] == order[i]:  # the bond to i is a bridge (or i is the start)
                    at = open_atoms.index(i)
                    if len(open_atoms) - at > 1:
                        systems.append(open_atoms[at:])
                    del open_atoms[at:]
    return systems


def written(color: dict[int, int], near: Near) -> tuple:
    """Atoms and bonds by colour, in order."""
    return tuple(sorted(color.values())), tuple(sorted((c, color[j], o) for i, c in color.items() for j, o in near[i] if c <= color[j]))


def _apart(color: dict[int, int], i: int, near: Near) -> dict[int, int]:
    return refined({j: 2 * c + (j == i) for j, c in color.items()}, near)


def first_ordering(color: dict[int, int], near: Near) -> tuple:
    """What is the same for equal coloured graphs and for no others: atoms that stay alike are singled out in turn, and the first in order counts."""
    count = 0

    def first(color: dict[int, int]) -> tuple | None:
        nonlocal count
        cells: dict[int, list[int]] = {}
        for i, c in color.items():
            cells.setdefault(c, []).append(i)
        alike = min(((len(x), c) for c, x in cells.items() if len(x) > 1), default=None)
        if alike is None:
            count += 1
            return written(color, near)
        best = None
        for i in cells[alike[1]]:
            got = first(_apart(color, i, near))
            if got is None or count > MOST_ORDERINGS:
                return None
            best = got if best is None else min(best, got)
        return best

    color = refined(color, near)
    return first(color) or tuple(sorted(written(_apart(color, i, near), near) for i in color))


def certificate(near: Near, label: dict[int, str]) -> str:
    """A text that is the same for equal graphs and for no others (but for cages beyond MOST_ORDERINGS).

    Refinement tells everything of chains, of branches and of single rings once their size is known. In ring systems with more
    bonds than atoms each atom is told by the first ordering of its system that begins with it.
    """
    systems = [(x, {i: [(j, o) for j, o in near[i] if j in set(x)] for i in x}) for x in ring_systems(near)]
    size = {i: len(x) if all(len(n) == 2 for n in inner.values()) else -len(x) for x, inner in systems for i in x}
    kind = {i: (label[i], size.get(i, 0)) for i in near}
    names = sorted(set(kind.values()))
    color = refined({i: names.index(k) for i, k in kind.items()}, near)
    fused = [(x, inner) for x, inner in systems if size[x[0]] < 0]
    told: list[tuple] = []
    while fused:
        own = {i: first_ordering({j: 2 * color[j] + (j == i) for j in x}, inner) for x, inner in fused for i in x}
        told = sorted({(color[i], t) for i, t in own.items()})
        place = {k: n for n, k in enumerate(told)}
        finer = refined({i: (len(told) + 1) * c + (place[c, own[i]] + 1 if i in own else 0) for i, c in color.items()}, near)
        stable = len(set(finer.values())) == len(set(color.values()))
        color = finer
        if stable:
            break
    return repr((sorted((c, *kind[i]) for i, c in color.items()), written(color, near), told))


def _digest(text: str) -> str:
    return blake2b(text.encode(), digest_size=12).hexdigest()


def structure_codes(text: str | None) -> tuple[str, str | None] | None:
    """The code of the largest fragment of a structure, and that of its rings with the bonds between them (None without rings); None for null, blank or unreadable text.

    A name behind the notation, stereo marks, charges, written hydrogens, ring numbers, the order of atoms and smaller
    fragments (salts, solvents) make no difference. Of several largest fragments the one with the greatest code counts.
    """
    words = (text or "").split()
    graph = read_graph(words[0]) if words else None
    if graph is None:
        return None
    atoms, bonds, fragment = graph
    most = max(map(fragment.count, set(fragment)))
    best: tuple[str, str | None] | None = None
    for part in sorted(set(fragment)):
        own = [i for i in range(len(atoms)) if fragment[i] == part]
        if len(own) < most:
            continue
        near: Near = {i: [] for i in own}
        for a, b, o in bonds:
            if a in near and b in near:
                near[a].append((b, o))
                near[b].append((a, o))
        code = _digest(certificate(near, {i: atoms[i] for i in own}))
        if best is None or code > best[0]:
            rings = {i for x in ring_systems(near) for i in x}
            core = {i: [(j, o) for j, o in near[i] if j in rings] for i in rings}
            best = code, _digest(certificate(core, {i: atoms[i] for i in rings})) if rings else None
    return best


def connectivity_code(text: str | None) -> str | None:
    """The code of the largest fragment alone (see ``structure_codes``)."""
    found = structure_codes(text)
    return found and found[0]
