"""Results of checks: headings, colours, expectations."""

import pytest

import edgeloom
from edgeloom import api, results
from edgeloom.errors import TechnicalError, UserError
from edgeloom.plans import edges as E

PLAIN = results.ResultOptions(color="never")


def test_messages_count_and_number_findings():
    one, two = results.Finding("Layer dependency violation", "a -> b"), results.Finding("Circular dependency detected", "a -> b\n-> a")
    assert results.shaped([], PLAIN) == results.Result(True, "No architecture violations found.")
    assert results.shaped([one], PLAIN) == results.Result(False, "Found 1 architecture violation:\n\n  1. Layer dependency violation\n     a -> b")
    assert results.shaped([one, two], PLAIN).message == "Found 2 architecture violations:\n\n  1. Layer dependency violation\n     a -> b\n\n  2. Circular dependency detected\n     a -> b\n     -> a"
    assert results.shaped([one, two], results.ResultOptions("never", limit=1)).message.startswith("Found more than 1 architecture violations:")
    assert results.shaped([one, two], results.ResultOptions("never", limit=1)).message.count("violation\n") == 1


def test_expected_violations_and_errors():
    expecting = results.ResultOptions("never", expect_violations=True)
    assert results.shaped([], expecting) == results.Result(False, "Expected architecture violations, but none were found.")
    found = results.shaped([results.Finding("x", "y")], expecting)
    assert found.passed and found.message.startswith("Found 1 architecture violation, as expected:")
    assert results.shaped_error(UserError("no such layer"), expecting) == results.Result(False, "Architecture rule is invalid: no such layer")
    assert results.shaped_error(TechnicalError("no file"), PLAIN).message == "Architecture check could not run: no file"
    with pytest.raises(UserError):
        results.ResultOptions(color="sometimes")
    with pytest.raises(UserError):
        results.ResultOptions(limit=0)


def test_colors_follow_choice_and_surroundings():
    assert results.styled("t", "red bold", "always") == "\x1b[1;31mt\x1b[0m" and results.styled("t", "red", "never") == "t"
    assert results.shaped([], results.ResultOptions("always")).message == "\x1b[32mNo architecture violations found.\x1b[0m"
    assert results.terminal_has_colors(True, {}) and not results.terminal_has_colors(False, {})
    for env in ({"NO_COLOR": ""}, {"TERM": "Dumb"}, {"CI": "TRUE"}):
        assert not results.terminal_has_colors(True, env)
    assert results.terminal_has_colors(True, {"CI": "false", "TERM": "xterm"})


def test_results_of_rules(spark):
    edges = E.graph(spark.createDataFrame([("src/a.rs", "src/b.rs", False, "use"), ("src/b.rs", "src/a.rs", False, "use"), ("src/a.rs", "tea", True, "use")], "source string, target string, external boolean, kind string"))
    files = api.Files(edges)
    got = {
        rule.findings()[0].message
        for rule in (files.should_not().depend_on_files().in_path("**"), files.should_not().depend_on_external_modules().matching("tea"), files.should().have_no_cycles(), files.should().have_name("x.rs"))
    }
    assert got == {"File dependency violation", "External module dependency violation", "Circular dependency detected", "File pattern violation"}
    bad = files.should().have_name("x.rs").result(results.ResultOptions("never", limit=1))
    assert not bad.passed and bad.message == "Found more than 1 architecture violations:\n\n  1. File pattern violation\n     src/a.rs"
    assert files.in_path("none/**").should().have_name("x").result(PLAIN).message.startswith("Found 1 architecture violation:\n\n  1. Empty test violation")
    wrong = api.MetricRule(edges).result(PLAIN)
    assert not wrong.passed and wrong.message == "Architecture rule is invalid: the rule has no condition"


def test_public_names_can_be_imported():
    assert all(getattr(edgeloom, name) is not None for name in edgeloom.__all__)
