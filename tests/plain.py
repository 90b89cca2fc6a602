"""The scores by plain loops over strings, written apart from the library: what its expressions are held against."""

import re

LEX = re.compile(r"[\w/.]+")
ALIASES = {"µg": "mcg", "ug": "mcg", "cc": "ml"} | {w + s: u for w, u in {"microgram": "mcg", "millilitre": "ml", "milliliter": "ml", "milligram": "mg", "kilogram": "kg", "gram": "g", "litre": "l", "liter": "l"}.items() for s in ("", "s")}
ALIASES |= {w: w + "s" for w in ("tablet", "capsule", "drop", "puff", "unit", "hour", "day")}


def numbers_with_units(text, units):
    out = []
    for m in re.finditer(r"\d+(?:\.\d+)?", text):
        if m.start() and re.match(r"[\w.]", text[m.start() - 1]):
            continue
        rest = text[m.end() :].lstrip()
        for u in units:
            if rest.startswith(u) and not re.match(r"[\w/]", rest[len(u) : len(u) + 1]):
                out.append((float(m[0]), ALIASES.get(u, u)))
                break
    return out


def cues(text, names):
    out, at = [], 0
    while at < len(text):
        for n in names:
            free = not (at and re.match(r"\w", text[at - 1])) and not re.match(r"\w", text[at + len(n) : at + len(n) + 1])
            if text.startswith(n, at) and free:
                out.append((n, len(LEX.findall(text[:at]))))
                at += len(n) - 1
                break
        at += 1
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def near(index, ref, hyp, radius=5):
    centre = 0 if len(ref) <= 1 else round(index / (len(ref) - 1) * max(len(hyp) - 1, 0))
    return hyp[max(centre - radius, 0) : centre + radius + 1]


def without_marks(text, marks):
    for m in marks:
        text = re.sub(rf"(?<!\w){re.escape(m)}(?!\w)", " ", text)
    return " ".join(text.split())


class Pair:
    def __init__(self, ref, hyp, lexicon, units, negations):
        hyp = hyp or ""
        self.ref, self.hyp, self.lexicon = ref.split(), hyp.split(), lexicon
        known = lambda t: [w for w in LEX.findall(t) if w in lexicon]
        self.drugs, self.written = known(ref), known(hyp)
        self.doses, self.hyp_doses = numbers_with_units(ref, units), numbers_with_units(hyp, units)
        self.cues, self.names = cues(ref, negations), negations
        self.wer = distance(self.ref, self.hyp) / len(self.ref) if self.ref else None

    def drug_fates(self):
        for m in self.drugs:
            index = self.ref.index(m) if m in self.ref else 0
            if any(distance(m, w) <= 1 for w in self.hyp):
                yield m, index, "survived", ""
            else:
                others = [w for w in near(index, self.ref, self.hyp) if w in self.lexicon and w not in self.drugs]
                yield m, index, "substituted" if others else "deleted", others[0] if others else ""

    def invented(self):
        open_, spoken, n = list(self.drugs), list(self.ref), 0
        for w in self.written:
            close = [(distance(m, w), k) for k, m in enumerate(open_)]
            if close and min(close)[0] <= 1:
                m = open_.pop(min(close)[1])
                if m in spoken:
                    spoken.remove(m)
                continue
            heard = [k for k, x in enumerate(spoken) if distance(x, w) <= 1]
            if heard:
                spoken.pop(heard[0])
            else:
                n += 1
        return n

    def dose_fates(self):
        left = list(self.hyp_doses)
        for value, unit in self.doses:
            for kind, test in (("correct", lambda d: d == (value, unit)), ("value", lambda d: d[1] == unit), ("unit", lambda d: d[0] == value)):
                hit = next((d for d in left if test(d)), None)
                if hit:
                    left.remove(hit)
                    yield value, unit, kind, hit
                    break
            else:
                yield value, unit, "missing", None

    def cue_fates(self):
        for cue, idx in self.cues:
            yield cue, idx, cue in [c for c, _ in cues(" ".join(near(idx, self.ref, self.hyp)), self.names)]


def scores(ref, hyp, lexicon, units, negations, marks):
    p = Pair(ref, hyp, lexicon, units, negations)
    stripped = Pair(without_marks(ref, marks), without_marks(hyp or "", marks), lexicon, units, negations)
    drugs, doses, kept = [f[2] for f in p.drug_fates()], [f[2] for f in p.dose_fates()], [f[2] for f in p.cue_fates()]
    return (p.wer, stripped.wer, len(drugs), drugs.count("survived"), drugs.count("substituted"), drugs.count("deleted"), len(p.written), p.invented(),
            len(doses), doses.count("correct"), doses.count("value"), doses.count("unit"), doses.count("missing"), len(kept), kept.count(True), kept.count(False))


def short(x):
    return str(int(x)) if x == int(x) else f"{x:.6f}".rstrip("0")


def findings(ref, hyp, lexicon, units, negations, marks):
    p = Pair(without_marks(ref, marks), without_marks(hyp or "", marks), lexicon, units, negations)
    if p.wer is not None and p.wer >= 0.8:
        return [("ASR-COLLAPSE", " ".join(p.ref[:15]), " ".join(p.hyp[:15]), 0)]
    out = [("DRUG-SUB" if h else "DRUG-DEL", m, h, i) for m, i, fate, h in p.drug_fates() if fate != "survived"]
    for value, unit, kind, hit in p.dose_fates():
        if kind != "correct":
            at = next((k for k, w in enumerate(p.ref) if w in (str(value), short(value))), 0)
            out.append(({"value": "DOSE-VAL", "unit": "DOSE-UNIT", "missing": "DOSE-MISS"}[kind], f"{short(value)} {unit}", f"{short(hit[0])} {hit[1]}" if hit else "", at))
    out += [("NEG-FLIP", c, "", i) for c, i, ok in p.cue_fates() if not ok]
    return sorted(out, key=lambda f: f[3])
