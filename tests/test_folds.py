"""State machines on worked examples."""

from quireflow.operators import folds


def run(step, inputs, state=None):
    outs = []
    for values in inputs:
        state, out = step(state, *values)
        outs.append(out)
    return state, outs


SLOW = (10.0, 8.0, 20, 30)


def limits(verdicts, start=None):
    return [o[:2] for o in run(folds.limits_step, [(v, *SLOW) for v in verdicts], start)[1]]


def test_two_overloaded_windows_halve_both_limits():
    assert limits(["overload"] * 3) == [(8, 20), (4, 10), (2, 5)]


def test_three_healthy_windows_then_a_tenth_per_window():
    assert limits(["healthy"] * 4, [4, 10, 0]) == [(4, 10), (4, 10), (5, 13), (6, 16)]


def test_limits_are_clamped_and_unknown_changes_nothing():
    assert limits(["healthy"], [10, 30, 5]) == [(10, 30)]
    assert limits(["overload"], [1, 1, -5]) == [(1, 1)]
    assert run(folds.limits_step, [("unknown", *SLOW)], [5, 12, -1]) == ([5, 12, -1], [(5, 12, 1, 0)])
    assert run(folds.limits_step, [("healthy", *SLOW)], [5, 12, -1])[0] == [5, 12, 1]


def test_breaker_opens_on_failure_rate_then_probes_then_closes():
    step = folds.breaker_step(4, 0.5, 10.0, 3)
    _, outs = run(step, [(t, o, False) for t, o in enumerate(["ok", "retry", "ok", "retry", "ok"])]
                  + [(13.0 + k, "ok", False) for k in range(4)])
    assert [o[0] for o in outs] == ["allow"] * 4 + ["deny"] + ["probe"] * 3 + ["allow"]
    assert outs[3][1] == "open" and outs[7][1] == "closed" and sum(o[2] for o in outs) == 1


def test_failed_probe_reopens_and_auth_trips_at_once():
    step = folds.breaker_step(4, 0.5, 10.0, 3)
    state, outs = run(step, [(0.0, "auth", False), (5.0, "ok", False), (10.0, "retry", False), (15.0, "ok", False)])
    assert [o[:2] for o in outs] == [("allow", "open"), ("deny", "open"), ("probe", "open"), ("deny", "open")]
    assert sum(o[2] for o in outs) == 2


def test_a_closed_breaker_forgets_what_came_before():
    step = folds.breaker_step(4, 0.5, 10.0, 3)
    first, _ = run(step, [(0.0, "auth", False)] + [(10.0 + k, "ok", False) for k in range(3)])
    assert first == run(step, [(0.0, "throttled", False)])[0]
    _, outs = run(folds.counting_trips(step), [(0.0, "auth", False), (10.0, "retry", False)])
    assert [o[2] for o in outs] == [1, 2]


def test_probes_without_a_verdict_are_handed_back():
    step = folds.breaker_step(4, 0.5, 10.0, 3)
    _, outs = run(step, [(0.0, "auth", False)] + [(10.0 + k / 10, "throttled", False) for k in range(9)] + [(12.0 + k, "ok", False) for k in range(4)])
    assert [o[0] for o in outs[1:]] == ["probe"] * 12 + ["allow"]


def test_retry_budget_grants_ten_of_twenty_five_and_refills():
    calls = [(0, False, False)] * 100 + [(0, True, False)] * 25 + [(2, True, False)] * 6
    granted = [o[0] for o in run(folds.retry_step, calls)[1]]
    assert sum(map(bool, granted[100:125])) == 10 and granted[125:] == [True] * 5 + [False]


def page(*deliveries):
    return run(folds.page_step, [(s, n, o, True) for s, n, o in deliveries])


def test_page_runs_through_both_stages_and_ignores_duplicates():
    state, outs = page(("fast", 1, "ok"), ("fast", 1, "ok"), ("slow", 1, "ok"), ("slow", 1, "ok"))
    assert [o[0] for o in outs] == ["ok", "duplicate", "ok", "duplicate"]
    assert state == ["COMPLETED", "slow", 0, 0, True, "vlm", False]


def test_three_failed_calls_leave_two_attempts_and_fall_back():
    state, outs = page(("fast", 1, "ok"), ("slow", 1, "retry"), ("slow", 1, "throttled"), ("slow", 1, "retry"), ("slow", 1, "retry"))
    assert [o[0] for o in outs] == ["ok", "failure", "throttled", "failure", "fallback"]
    assert state == ["COMPLETED", "slow", 0, 2, True, "layout_fallback", True]


def test_giving_up_in_the_fast_stage_goes_on_without_a_result():
    state, _ = page(("fast", 4, "ok"), ("slow", 1, "permanent"))
    assert state == ["FAILED", "slow", 0, 0, False, "none", True]
    assert page(("fast", 1, "permanent"))[0][0] == "FAILED"


def test_a_spent_budget_defers_without_using_an_attempt():
    state, outs = run(folds.page_step, [("fast", 1, "retry", True), ("fast", 1, "ok", False), ("fast", 1, "ok", True)])
    assert [o[0] for o in outs] == ["failure", "budget_deferred", "ok"] and state[2] == 1


def test_frames_come_out_in_document_order():
    frames = [(1, None, None, 4), (2, 2, "c", 4), (3, 1, "b", 4), (4, 0, "a", 4), (4, 0, "a", 4), (5, 3, "d", 4)]
    _, outs = run(folds.assembly_step, frames)
    assert [[p for p, _ in o[0]] for o in outs] == [[], [], [], [0, 1, 2], [], [3]]
    assert [o[1] for o in outs] == [False] * 5 + [True]
