"""The standard normal distribution as SQL expressions, to double precision.

Spark has no error function, so both directions are rational approximations
written as nested products: they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients (Hart 1968 for the distribution function,
# Wichura 1988 for its inverse), constant term first.
CDF_TOP = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
CDF_BOTTOM = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
CENTRE_TOP = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
CENTRE_BOTTOM = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
MIDDLE_TOP = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640)
MIDDLE_BOTTOM = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9)
TAIL_TOP = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_BOTTOM = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}D)"
    return text


def normal_cdf(x: str) -> Column:
    """Probability below ``x`` (SQL text); null stays null."""
    a = f"abs(double({x}))"
    near = f"exp(-{a} * {a} / 2) * {_horner(a, CDF_TOP)} / {_horner(a, CDF_BOTTOM)}"
    far = f"exp(-{a} * {a} / 2) / 2.5066282746310002D / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65D)))))"
    tail = f"CASE WHEN {a} > 37 THEN 0D WHEN {a} < 7.0710678118654755D THEN {near} ELSE {far} END"
    return F.expr(f"CASE WHEN ({x}) IS NOT NULL THEN if(({x}) > 0, 1 - ({tail}), {tail}) END")


def normal_quantile(p: str) -> Column:
    """The ``x`` with ``p`` (SQL text) below it; null unless 0 < p < 1."""
    p = f"double({p})"
    q, r = f"({p} - 0.5D)", f"sqrt(-ln(least({p}, 1 - {p})))"
    c, m, t = f"(0.180625D - {q} * {q})", f"({r} - 1.6D)", f"({r} - 5D)"
    centre = f"{q} * {_horner(c, CENTRE_TOP)} / {_horner(c, CENTRE_BOTTOM)}"
    side = f"if({r} <= 5D, {_horner(m, MIDDLE_TOP)} / {_horner(m, MIDDLE_BOTTOM)}, {_horner(t, TAIL_TOP)} / {_horner(t, TAIL_BOTTOM)})"
    return F.expr(f"CASE WHEN {p} > 0 AND {p} < 1 THEN if(abs({q}) <= 0.425D, {centre}, sign({q}) * {side}) END")
