"""The damped scoring of the fits as DuckDB SQL: a recursive query whose rows are the state of one fit after one step.

The same stop rule, damping and bounds as the fits themselves; the loss at the end is compared, and predictions follow from
the same path of parameters.
"""
from __future__ import annotations

from foresift.functions.normal import INV_SQRT_PI, cdf_sql, phi_sql

TOL, CALM, DAMP_END, BOUND = 1e-13, 3, 1e8, 40.0


def _solve(names: list[str], out: list[str], ridge: bool = True) -> str:
    """Symmetric system by Cramer's rule, damped unless without ridge; gradient g<name>, curvature h<name><name>."""
    n = range(len(names))
    h = [[f"h{names[min(i, j)]}{names[max(i, j)]}" for j in n] for i in n]
    top = f"(1e-14::DOUBLE*(1+greatest({', '.join(h[i][i] for i in n)})))"
    m = [[f"({h[i][i]}+{h[i][i]}*damp+{top})" if ridge and i == j else h[i][j] for j in n] for i in n]

    def det(a: list[list[str]]) -> str:
        if len(a) == 1:
            return a[0][0]
        minors = [[row[:j] + row[j + 1:] for row in a[1:]] for j in range(len(a))]
        return "(" + "".join(f"{'-' if j % 2 else '+'}{a[0][j]}*{det(x)}" for j, x in enumerate(minors)).lstrip("+") + ")"

    swapped = [[[f"g{names[i]}" if j == k else m[i][j] for j in n] for i in n] for k in n]
    return ", ".join(f"{det(a)}/{det(m)} AS {name}" for a, name in zip(swapped, out))


def emos_fits(source: str, keys: list[str], min_rows: int = 1, predictors=("ens_mean",), v: str = "ens_var",
              y: str = "t2m_obs") -> str:
    """SELECT of keys, a, b, c, d[, e], n_rows, loss for every group of `source` (a table or a sub-select)."""
    if not keys:
        source, keys = f"(SELECT *, 0 AS _all FROM {source})", ["_all"]
    k = "".join(f"{c}, " for c in keys)
    sk = "".join(f"s.{c}, " for c in keys)
    on = " AND ".join(["true", *(f"t.{c} = s.{c}" for c in keys)])
    i = f"({INV_SQRT_PI!r})::DOUBLE"
    gm, gs = "(1.0-2.0*cdf)", f"(2.0*pdf-{i})"
    w, jc, jd = f"({i}/sg)", "(ec/(2.0*sg))", "(edv/(2.0*sg))"
    xs = [f"x{n}" for n in range(len(predictors))]
    # location parameters with what they multiply, then the log variances
    of = dict(zip(["a", "b", "e"], ["1.0", *xs]))
    loc, params = list(of), [*of, "c", "d"]
    terms = {"loss": f"sg*(z*(2.0*cdf-1.0)+{gs})"} | {f"g{p}": f"{gm}*{x}" for p, x in of.items()}
    terms |= {"gc": f"{gs}*{jc}", "gd": f"{gs}*{jd}"}
    terms |= {f"h{p}{q}": f"{w}*{of[p]}*{of[q]}" for n, p in enumerate(loc) for q in loc[n:]}
    terms |= {"hcc": f"0.5*{w}*{jc}*{jc}", "hcd": f"0.5*{w}*{jc}*{jd}", "hdd": f"0.5*{w}*{jd}*{jd}"}
    sum_names = list(terms)[1:]
    state = [*params, *(f"t{p}" for p in params), "loss", "damp", "calm", *sum_names]
    held = ", ".join(f"any_value(s.{c}) AS o_{c}" for c in state)
    sums = ", ".join(f"avg({t}) AS n_{c}" for c, t in terms.items())
    finite = " AND ".join(f"isfinite(n_{c})" for c in terms)
    keep = ", ".join(f"CASE WHEN ok THEN n_{c} ELSE o_{c} END AS {c}" for c in terms)
    best = ", ".join(f"CASE WHEN ok THEN o_t{c} ELSE o_{c} END AS {c}" for c in params)
    cells = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for x, n in zip([*predictors, v, y], [*xs, "v", "y"]))
    clean = f"SELECT * FROM (SELECT {k}{cells} FROM {source}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*xs, "v", "y"])
    start = ", ".join(f"{int(p == 'b')}::DOUBLE AS {t}{p}" for t in ("", "t") for p in params)
    first = ", ".join([start, "'inf'::DOUBLE AS loss", "1e-3::DOUBLE AS damp", "0 AS calm", *(f"0.0::DOUBLE AS {c}" for c in sum_names)])
    moved = ", ".join([*(f"{p}-d{p} AS t{p}" for p in loc),
                       *(f"greatest(-{BOUND}, least({BOUND}, {p}-greatest(-3.0, least(3.0, d{p})))) AS t{p}" for p in "cd")])
    mu = "s.ta" + "".join(f"+s.t{p}*t.{x}" for p, x in list(of.items())[1:])
    sg = "sqrt(exp(s.tc)+exp(s.td)*t.v+1e-300::DOUBLE)"
    return f"""(WITH RECURSIVE data AS MATERIALIZED ({clean}), fit AS (
    SELECT {k}0 AS step, 0::BIGINT AS n_rows, true AS going, {first} FROM data GROUP BY {', '.join(keys)}
    UNION ALL
    SELECT {k}step, n_rows, going, {', '.join(params)}, {moved}, loss, damp, calm, {', '.join(sum_names)} FROM (
    SELECT *, {_solve(loc, [f'd{p}' for p in loc])}, {_solve(['c', 'd'], ['dc', 'dd'])} FROM (
    SELECT *, calm < {CALM} AND damp < {DAMP_END} AS going FROM (
    SELECT {k}step, n_rows, {best}, {keep}, CASE WHEN ok THEN greatest(o_damp*0.2, 1e-8::DOUBLE) ELSE o_damp*8.0 END AS damp,
        CASE WHEN ok AND o_loss-n_loss <= {TOL}::DOUBLE*(1.0+abs(n_loss)) THEN o_calm+1 WHEN ok THEN 0 ELSE o_calm END AS calm FROM (
    SELECT *, coalesce({finite} AND n_loss <= o_loss, false) AS ok FROM (
    SELECT {sk}any_value(s.step)+1 AS step, count(*) AS n_rows, {held}, {sums} FROM (
    SELECT s.*, {', '.join(f't.{x}' for x in xs)}, e.ec, e.edv, e.sg, e.z, {cdf_sql('e.z')} AS cdf, {phi_sql('e.z')} AS pdf
    FROM fit s JOIN data t ON {on}, LATERAL (SELECT exp(s.tc) AS ec, exp(s.td)*t.v AS edv, {sg} AS sg,
                 greatest(-1e150::DOUBLE, least(1e150::DOUBLE, (t.y-({mu}))/{sg})) AS z) e
    WHERE s.going) s GROUP BY {', '.join(f's.{c}' for c in keys)}))))))
    SELECT {k}{', '.join(f'arg_max({p}, step) AS {p}' for p in params)}, max(n_rows) AS n_rows, arg_max(loss, step) AS loss
    FROM fit GROUP BY {', '.join(keys)} HAVING max(n_rows) >= {min_rows})"""


def refined(fits: str, source: str, keys: list[str], steps: int = 2, x: str = "ens_mean", v: str = "ens_var",
            y: str = "t2m_obs") -> str:
    """The fits after some undamped Newton steps with the exact curvature: parameters to the last digits."""
    i = f"({INV_SQRT_PI!r})::DOUBLE"
    mm, ms, ss, gs = "(2.0*pdf/sg)", "(2.0*pdf*z/sg)", "(2.0*pdf*z*z/sg)", f"(2.0*pdf-{i})"
    jc, jd = "(ec/(2.0*sg))", "(edv/(2.0*sg))"
    terms = {"ga": "(1.0-2.0*cdf)", "gb": "(1.0-2.0*cdf)*x", "gc": f"{gs}*{jc}", "gd": f"{gs}*{jd}", "haa": mm, "hab": f"{mm}*x",
             "hbb": f"{mm}*x*x", "hac": f"{ms}*{jc}", "had": f"{ms}*{jd}", "hbc": f"{ms}*{jc}*x", "hbd": f"{ms}*{jd}*x",
             "hcc": f"{ss}*{jc}*{jc}+{gs}*({jc}-{jc}*{jc}/sg)", "hcd": f"{ss}*{jc}*{jd}-{gs}*{jc}*{jd}/sg",
             "hdd": f"{ss}*{jd}*{jd}+{gs}*({jd}-{jd}*{jd}/sg)"}
    k = ", ".join(keys)
    for _ in range(steps):
        fits = f"""(SELECT {k}, n_rows, loss, a-da AS a, b-db AS b, greatest(-{BOUND}, c-dc) AS c, greatest(-{BOUND}, d-dd) AS d FROM (
            SELECT *, {_solve(list('abcd'), ['da', 'db', 'dc', 'dd'], ridge=False)} FROM (
            SELECT {k}, any_value(n_rows) AS n_rows, any_value(loss) AS loss, {', '.join(f'any_value({p}) AS {p}' for p in 'abcd')},
                {', '.join(f'avg({t}) AS {n}' for n, t in terms.items())} FROM (
            SELECT *, {cdf_sql('z')} AS cdf, {phi_sql('z')} AS pdf FROM (SELECT *, (y-(a+b*x))/sg AS z FROM (
            SELECT *, sqrt(ec+edv) AS sg FROM (SELECT {', '.join(f'f.{c}' for c in keys)}, f.n_rows, f.loss, f.a, f.b, f.c, f.d,
                CAST(r.{x} AS DOUBLE) AS x, CAST(r.{y} AS DOUBLE) AS y, exp(f.c) AS ec, exp(f.d)*r.{v} AS edv
                FROM {fits} f JOIN {source} r ON {' AND '.join(f'f.{c} = r.{c}' for c in keys)})))) GROUP BY {k})))"""
    return fits


def tiered(source: str, tiers: list[tuple[str, list[str], int]]) -> str:
    """SELECT of the columns of `source`, tier and q: the first tier with a fit of enough rows; NULL when none applies."""
    from foresift.plans import ctes as C
    joins, number, values = "", "CASE ", {c: "CASE " for c in "abcd"}
    for i, (fits, keys, least) in enumerate(tiers):
        joins += f" LEFT JOIN {fits} f{i} ON " + " AND ".join(["true", *(f"f{i}.{c} = t.{c}" for c in keys)])
        test = f"WHEN f{i}.n_rows >= {least} THEN "
        number += test + f"{i} "
        for c in values:
            values[c] += test + f"f{i}.{c} "
    picked = ", ".join(f"{text}END AS p_{c}" for c, text in values.items())
    return (f"SELECT *, CASE WHEN tier IS NOT NULL THEN {C.gaussian('(p_a+p_b*ens_mean)', 'sqrt(exp(p_c)+exp(p_d)*ens_var)')} END AS q "
            f"FROM (SELECT t.*, {number}END AS tier, {picked} FROM {source} t{joins})")
