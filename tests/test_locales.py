from codegrove.functions import locales
from codegrove.plans import ids


def test_match():
    have = {ids.EN_GB, ids.EN_US, 722131000}
    assert locales.match("fr;q=0.5, en-GB", have) == [ids.EN_GB, 722131000]
    assert locales.match("en", have) == [ids.EN_GB, ids.EN_US]
    assert locales.match(f"en-x-{ids.EN_US}", have) == [ids.EN_US]
    assert locales.match("sv", have) == [] and locales.match("sv", have, fallback="en-us") == [ids.EN_US]
    assert locales.dialect("en-nhs-dmd") == 999000671000001103 and locales.dialect("xx") is None
