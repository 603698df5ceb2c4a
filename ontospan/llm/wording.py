"""How values of a field are typed around the names of a canonical list: data for mapping, one object per language and field."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Wording:
    """All words folded. before and after: patterns of what surrounds a condition; around_drug: words that aren't part of a drug's
    name; forms: words of a form, by the form; units: by the word or sign, how many micrograms; drug: the type that has amounts."""

    drug: str = ""
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    around_drug: tuple[str, ...] = ()
    forms: dict[str, str] = field(default_factory=dict)
    units: dict[str, int] = field(default_factory=dict)


# Words of Vietnamese notes.
VIETNAMESE = Wording(
    drug="THUỐC",
    before=("benh", "hoi chung", "td", "t d", "theo doi", "chan doan", "cd", "nghi ngo", "nghi"),
    after=("td", "hen tai kham", "chua loai tru", "da on", "ngay thu [0-9]+", "cu", "man"),
    around_drug=tuple("vien nen nang dung dich uong thuoc tiem phong thich keo dai oral tablet tab capsule cap solution injection extended release x khi dau po bid tid qd prn sang trua chieu toi ngay lan moi truoc sau an ong goi lo hop can".split()),
    forms={"nen": "tablet", "tablet": "tablet", "nang": "capsule", "capsule": "capsule", "dich": "solution", "solution": "solution", "tiem": "injection", "injection": "injection", "phong": "extended", "extended": "extended"},
    units={"mcg": 1, "µg": 1, "ug": 1, "microgam": 1, "mg": 1000, "miligam": 1000, "milligram": 1000, "g": 1000000, "gam": 1000000, "gram": 1000000},
)
