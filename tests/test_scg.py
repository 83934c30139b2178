from codegrove.plans import scg

LOOK = scg.Lookup(
    above={5: frozenset({1, 2}), 2: frozenset({1}), 11: frozenset({10})},
    defined=frozenset({5}),
    active=frozenset({1, 2, 5, 10, 11, 100}),
    known=frozenset({1, 2, 5, 10, 11, 100}),
    parents={5: (2,), 2: (1,)},
    properties={5: {1: frozenset({(100, 11)})}},
)


def test_round_trip():
    source = '<<< 73211009 |a| + 24700007 : 363698007 = 39057004, { 116676008 = (24700007 : 363698007 = 39057004), 363698007 = #2.5 }, { 116676008 = "x\\"y" }'
    e = scg.parse(source)
    assert scg.render(e) == source
    assert scg.parse(scg.render(scg.canonical(e), terms="strip")) == scg.canonical(scg.strip_terms(e))
    assert not scg.is_valid_expression("24700007 :") and not scg.is_valid_expression("24700008")


def test_subsumption():
    a = scg.classifiable(scg.Expression((scg.Concept(2),), (), (((scg.Concept(100), scg.Concept(10)),),)))
    b = scg.normalise(scg.Expression((scg.Concept(5),)), LOOK)
    assert b.focus == {2} and b.groups == {frozenset({(100, 11)})}
    assert scg.relation(LOOK, a, b) == "subsumes" and scg.relation(LOOK, b, a) == "subsumed-by"
    assert scg.classifiable(scg.from_classifiable(b)) == b
    assert scg.to_ecl(b) == "<< 2 : { << 100 = << 11 }"
    assert scg.errors(scg.Expression((scg.Concept(7),)), LOOK) == [("not-found", 7)]


def test_normal_form_keeps_kinds_apart():
    """An ungrouped attribute is met by ungrouped ones only; all focus concepts stay; attributes are compared within their type."""
    whole = scg.Lookup(
        above={2: frozenset({1}), 11: frozenset({10}), 101: frozenset({100})},
        defined=frozenset(),
        active=frozenset({1, 2, 10, 11, 100, 101}),
        known=frozenset({1, 2, 3, 10, 11, 100, 101}),
        parents={},
        properties={2: {0: frozenset({(100, 10), (100, 11), (101, 10)}), 1: frozenset({(100, 11)}), 2: frozenset({(100, 10)})}},
    )
    n = scg.normalise(scg.Expression((scg.Concept(1), scg.Concept(2))), whole)
    assert n.focus == {1, 2} and n.ungrouped == {(100, 11), (101, 10)} and n.groups == {frozenset({(100, 11)})}
    loose, grouped = (scg.Classifiable(frozenset({1}), *x) for x in ((frozenset({(100, 10)}),), (frozenset(), frozenset({frozenset({(100, 11)})}))))
    assert scg.relation(whole, loose, grouped) == "not-subsumed" and not scg.subsumes(whole, scg.Classifiable(frozenset()), loose)
    assert scg.subsumes(whole, loose, scg.Classifiable(frozenset({2}), frozenset({(101, 11)})))
    nested = scg.parse("100001 : 100 = (100002)".replace("100001", "000001").replace("100002", "000002").replace(" 100 ", " 000100 "), check_ids=False)
    assert scg.normalise(nested, whole).ungrouped == {(100, scg.normalise(scg.Expression((scg.Concept(2),)), whole))}
    for c in (3, 4):
        try:
            scg.normalise(scg.Expression((scg.Concept(c),)), whole)
            raise AssertionError("an inactive or unknown concept")
        except scg.ScgError:
            pass
