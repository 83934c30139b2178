"""Language ranges matched against installed language reference sets."""

from __future__ import annotations

from ..plans import ids

#: Language tags and their reference sets in order of preference.
LOCALES = {
    "da-dk": [554461000005103],
    "de-de": [722130004],
    "en-au": [32570271000036106],
    "en-ca": [19491000087109],
    "en-gb": [999001261000000100, 999000691000001104, 999000671000001103, 999000681000001101, ids.EN_GB, 999001251000000103],
    "en-ie": [21000220103],
    "en-nz": [271000210107],
    "en-us": [ids.EN_US],
    "es-ar": [450828004],
    "es-es": [448879004],
    "es-uy": [5641000179103],
    "et-ee": [71000181105],
    "fr-be": [21000172104],
    "fr-ca": [20581000087109],
    "fr-fr": [722131000],
    "ja-ja": [722129009],
    "mi": [291000210106],
    "nb-no": [61000202103],
    "nl-be": [31000172101],
    "nl-nl": [31000146106],
    "nn-no": [91000202106],
    "sv-se": [46011000052107],
    "zh": [722128001],
}
#: Dialect aliases that are no language tags, and their reference sets.
DIALECTS = {
    "en-gb": ids.EN_GB,
    "en-int-gmdn": 608771002,
    "en-nhs-clinical": 999001261000000100,
    "en-nhs-dmd": 999000671000001103,
    "en-nhs-pharmacy": 999000691000001104,
    "en-uk-drug": 999000681000001101,
    "en-uk-ext": 999001251000000103,
}


def dialect(alias: str) -> int | None:
    """The language reference set of a dialect alias or of a tag."""
    key = alias.lower()
    return DIALECTS.get(key) or next(iter(LOCALES.get(key, [])), None)


def ranges(header: str | None) -> list[str]:
    """Language ranges of an Accept-Language header, best first; weight 0 leaves out."""
    found = []
    for k, part in enumerate((header or "").split(",")):
        name, _, rest = part.strip().partition(";")
        if not name:
            continue
        try:
            q = float(rest.partition("=")[2] or 1)
        except ValueError:
            continue
        if q > 0:
            found.append((-q, k, name.strip().lower()))
    return [x[2] for x in sorted(found)]


def available(installed: set[int]) -> dict[str, int]:
    """Tags with an installed reference set, and the first such."""
    return {tag: next(r for r in sets if r in installed) for tag, sets in LOCALES.items() if installed.intersection(sets)}


def match(header: str | None, installed: set[int], *, fallback: str | None = None) -> list[int]:
    """Reference sets for a header, best first: `xx-x-<id>` names one itself, a range takes its tag and all that begin with it and '-'."""
    have = available(installed)
    out: list[int] = []
    for r in ranges(header):
        _, private, digits = r.partition("-x-")
        if private and digits.isdigit():
            hits = [int(digits)] if int(digits) in installed else []
        else:
            hits = [v for k, v in have.items() if r == "*" or k == r or k.startswith(f"{r}-")]
        out += [h for h in hits if h not in out]
    if not out and fallback is not None:
        out = match(fallback, installed)
        if not out:
            raise ValueError("no installed language reference set for the fallback")
    return out
