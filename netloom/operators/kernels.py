"""Dense numeric kernels. They run on one machine's arrays: on the driver behind a size check, or
one task per sample, permutation or replicate."""

from __future__ import annotations

import numpy as np


def normalize(x: np.ndarray) -> np.ndarray:
    """(row z + column z) / sqrt 2; without variance the global z takes a side's place."""
    with np.errstate(all="ignore"):
        r = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
        c = (x - x.mean(0)) / x.std(0)
        a = (x - x.mean()) / x.std()
    return (np.where(np.isfinite(r), r, a) + np.where(np.isfinite(c), c, a)) / np.sqrt(2)


def tanimoto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = x @ y
    return a / np.sqrt(np.abs((y * y).sum(0) + (x * x).sum(1)[:, None] - np.abs(a)))


def diagonal(m: np.ndarray, num: int, alpha: float, step: int) -> None:
    off = m.copy()
    np.fill_diagonal(off, np.nan)
    np.fill_diagonal(m, np.nanstd(off, axis=1) * num * np.exp(2 * alpha * step))


def correlation(expr: np.ndarray) -> np.ndarray:
    """genes x genes; 0 without variance, 1 on the diagonal."""
    z = expr - expr.mean(1, keepdims=True)
    s = np.sqrt((z * z).sum(1))
    z = np.divide(z, s[:, None], out=np.zeros_like(z), where=s[:, None] > 0)
    c = z @ z.T
    np.fill_diagonal(c, 1.0)
    return c


def rank_correlation(expr: np.ndarray) -> np.ndarray:
    from netloom.functions.tails import mean_ranks

    return correlation(np.array([mean_ranks(x) for x in expr]).reshape(expr.shape))


def kendall_correlation(expr: np.ndarray) -> np.ndarray:
    """Tau-b of all rows: for each sample, signs of its differences to the others."""
    n = expr.shape[1]
    both, own = np.zeros((len(expr), len(expr))), np.zeros(len(expr))
    for k in range(n - 1):
        s = np.sign(expr[:, k + 1 :] - expr[:, k : k + 1])
        both += s @ s.T
        own += (s * s).sum(1)
    d = np.sqrt(np.outer(own, own))
    out = np.divide(both, d, out=np.zeros_like(both), where=d > 0)
    np.fill_diagonal(out, 1.0)
    return out


def panda(c, p, w, threshold=0.001, alpha=0.1, frozen=None, rounds=500):
    """Message passing between co-regulation c, cooperation p and regulation w (all normalised)
    until the mean change of w is below the threshold. ``frozen`` rows and columns of p keep
    their values off the diagonal. Returns w, the number of steps, the last change, p and c. Raises
    if ``rounds`` don't suffice."""
    c, p, w = c.copy(), p.copy(), w.copy()
    fixed = p.copy()
    t, g = w.shape
    change, step = np.inf, 0
    while change > threshold and step < rounds:
        ra = 0.5 * (tanimoto(p, w) + tanimoto(w, c))
        change = float(np.abs(w - ra).mean())
        w = (1 - alpha) * w + alpha * ra
        if change > threshold:
            new = tanimoto(w, w.T)
            diagonal(new, t, alpha, step)
            p = (1 - alpha) * p + alpha * new
            if frozen is not None and len(frozen):
                d = np.diag(p).copy()
                p[frozen], p[:, frozen] = fixed[frozen], fixed[:, frozen]
                np.fill_diagonal(p, d)
            new = tanimoto(w.T, w)
            diagonal(new, g, alpha, step)
            c = (1 - alpha) * c + alpha * new
        step += 1
    if not change <= threshold:
        raise RuntimeError(f"message passing did not settle in {rounds} rounds")
    return w, step, change, p, c


def otter(w, p, c, lam=0.035, gamma=0.335, rounds=60, eta=1e-5, bexp=1.0):
    """Gradient descent with ADAM moments on |WW' - P|, |W'W - C|."""
    c = c / np.trace(c)
    p = p / np.trace(p) if np.trace(p) > 0 else p
    w = w / np.sqrt(np.trace(w @ w.T))
    p = -(1 - lam) * p + gamma * np.eye(len(p))
    c = -lam * c
    m, v, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.9, 0.999
    for i in range(1, rounds + 1):
        grad = w @ w.T @ w + p @ w + w @ c
        m = b1 * m + 4 * (1 - b1) * grad
        v = b2 * v + 16 * (1 - b2) * grad * grad
        t1, t2 = b1 ** (bexp + i), b2 ** (bexp + i)
        root = np.sqrt(1 - t2)
        w = w - root / (1 - t1) * eta * m / (1e-8 * root + np.sqrt(v))
    return w


def dragon_risk(gamma, t):
    """Expected squared error of the shrunken covariance at lambdas 1 - gamma^2; t holds the
    constant and the terms of each layer, each layer squared, both layers and their cross block."""
    g1, g2 = gamma
    l1, l2 = 1 - g1 * g1, 1 - g2 * g2
    const, a1, a2, b1, b2, both, cross = t
    return const + l1 * (a1 + l1 * b1 + l2 * both) + l2 * (a2 + l2 * b2) + g1 * g2 * cross


def var_s(x: np.ndarray) -> np.ndarray:
    """Variances of the entries of the covariance matrix of samples x variables."""
    n = len(x)
    z = x - x.mean(0)
    w = np.einsum("si,sj->sij", z, z)
    return n / (n - 1) ** 3 * ((w - w.mean(0)) ** 2).sum(0)


def esq_s(x: np.ndarray) -> np.ndarray:
    n = len(x)
    z = x - x.mean(0)
    return (z.T @ z / n) ** 2 * n * n / (n - 1) ** 2


def dragon(x1: np.ndarray, x2: np.ndarray, grid: int = 101):
    """Two-layer shrinkage: cov, precision, partial correlation, lambdas. x: samples x variables."""
    p1 = x1.shape[1]
    x = np.hstack([(v - v.mean(0)) / np.where(v.std(0, ddof=1) > 0, v.std(0, ddof=1), 1) for v in (x1, x2)])
    var, esq = var_s(x), esq_s(x)
    a, b = slice(0, p1), slice(p1, None)
    off = lambda m, s: m[s, s].sum() - np.trace(m[s, s])
    v12, e12 = var[a, b].sum(), esq[a, b].sum()
    t = (
        var[a, a].sum() + var[b, b].sum() - 2 * v12 + 4 * e12,
        -2 * (off(var, a) + e12), -2 * (off(var, b) + e12), off(esq, a), off(esq, b), 2 * e12, 4 * (v12 - e12),
    )
    axis = np.linspace(0, 1, grid)
    g1, g2 = np.meshgrid(axis, axis, indexing="ij")
    risk = dragon_risk((g1, g2), t)
    best = np.array([axis[i] for i in np.unravel_index(np.argmin(risk), risk.shape)])
    step = axis[1]
    for _ in range(40):  # shrinking pattern search inside [0, 1]^2
        near = np.clip(best + step * np.array([[i, j] for i in (-1, 0, 1) for j in (-1, 0, 1)]), 0, 1)
        r = dragon_risk(near.T, t)
        if r.min() < dragon_risk(best, t) - 1e-15:
            best = near[int(np.argmin(r))]
        else:
            step /= 2
    cov = np.cov(x, rowvar=False)
    scale = np.ones_like(cov)
    scale[a, a], scale[b, b], scale[a, b], scale[b, a] = best[0] ** 2, best[1] ** 2, best[0] * best[1], best[0] * best[1]
    np.fill_diagonal(scale, 1.0)
    cov = cov * scale
    prec = np.linalg.inv(cov)
    return {"cov": cov, "prec": prec, "ggm": partial_correlation(prec), "lambdas": 1 - best**2, "gammas": best, "risk_grid": risk}


def partial_correlation(prec: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(prec))
    out = -prec / np.outer(d, d)
    np.fill_diagonal(out, 0.0)
    return out


def gaussian_log_likelihood(cov: np.ndarray, s: np.ndarray, n: int) -> float:
    sign, logdet = np.linalg.slogdet(cov)
    return -n / 2 * (len(cov) * np.log(2 * np.pi) + logdet + np.trace(np.linalg.solve(cov, s))) if sign > 0 else -np.inf


def cobra(x: np.ndarray, expr: np.ndarray):
    """Decompose co-expression by covariates x (samples x q): psi, Q, D and G, by the eigenvectors
    of the samples' Gram matrix, as samples are far fewer than genes."""
    n = expr.shape[1]
    g = expr - expr.mean(1, keepdims=True)
    norm = np.sqrt((g * g).sum(1, keepdims=True))
    g = np.divide(g, norm, out=np.zeros_like(g), where=norm > 0)
    val, vec = np.linalg.eigh(g.T @ g)
    order = np.argsort(val)[::-1]
    val, vec = val[order], vec[:, order]
    keep = val > 1e-10 * max(val[0], 1e-300)
    q = g @ vec[:, keep] / np.sqrt(val[keep])
    hat = np.linalg.pinv(x.T @ x) @ x.T
    qg = q.T @ g
    psi = np.array([((qg * (n * h)) * qg).sum(1) for h in hat])
    return {"psi": psi, "Q": q, "D": val[keep], "G": g}


def shrunken_partial_correlation(expr: np.ndarray) -> np.ndarray:
    """Partial correlations of genes x samples, 1 on the diagonal, from correlations shrunk towards
    none by the share that minimises the expected squared error: the correlations' summed
    variances over their summed squares."""
    n = expr.shape[1]
    z = expr - expr.mean(1, keepdims=True)
    sd = z.std(1, ddof=1, keepdims=True)
    z = np.divide(z, sd, out=np.zeros_like(z), where=sd > 0)
    r = z @ z.T / (n - 1)
    mean = z @ z.T / n
    var = n / (n - 1) ** 3 * ((z * z) @ (z * z).T - n * mean * mean)
    off = ~np.eye(len(r), dtype=bool)
    share = min(1.0, max(0.0, var[off].sum() / max((r[off] ** 2).sum(), 1e-300)))
    shrunk = (1 - share) * r
    np.fill_diagonal(shrunk, 1.0)
    out = partial_correlation(np.linalg.inv(shrunk + 1e-12 * np.eye(len(r))))
    np.fill_diagonal(out, 1.0)
    return out


def cobra_of(x: np.ndarray, g: np.ndarray, c: np.ndarray) -> dict:
    """Decompose a similarity c of the rows of g by covariates x (samples x q), along as many leading
    eigenvectors of c as there are samples."""
    n = g.shape[1]
    val, vec = np.linalg.eigh(c)
    top = np.argsort(val)[::-1][: min(n, len(c))]
    q = vec[:, top]
    qg = q.T @ g  # columns of q are orthonormal
    hat = np.linalg.pinv(x.T @ x) @ x.T
    return {"psi": np.array([(qg * (n * h) * qg).sum(1) for h in hat]), "Q": q, "D": val[top], "G": g}


def transition_ols(n1: np.ndarray, n2: np.ndarray, remove_diagonal: bool = True) -> np.ndarray:
    """Least-squares change of each target tf (tfs x genes) on the source tfs, on residuals of the
    target on its own source."""
    a, b = ((m - m.mean(1, keepdims=True)) for m in (n1, n2))
    t = len(a)
    out = np.zeros((t, t))
    for i in range(t):
        y = b[i] - a[i] * ((a[i] @ b[i]) / max(a[i] @ a[i], 1e-300))
        others = np.array([j for j in range(t) if j != i])
        coef = np.linalg.lstsq(a[others].T, y, rcond=None)[0] if len(others) else []
        out[others, i] = coef
        if not remove_diagonal:
            out[i, i] = (a[i] @ b[i]) / max(a[i] @ a[i], 1e-300)
    return np.where(np.abs(out) < 1e-12, 0.0, out)


def transition_kabsch(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rotation of centred p (points x axes) onto q, of determinant 1."""
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    d = np.eye(len(u))
    d[-1, -1] = np.sign(np.linalg.det(u @ vt)) or 1.0
    return u @ d @ vt


def transition_pinv(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return n2 @ np.linalg.pinv(n1)


def transition_lasso(n1: np.ndarray, n2: np.ndarray, penalty: float = 0.01, rounds: int = 200) -> np.ndarray:
    a, b = ((m - m.mean(1, keepdims=True)) for m in (n1, n2))
    gram, cross, n = a @ a.T, a @ b.T, a.shape[1]
    w = np.zeros_like(cross)
    for _ in range(rounds):
        for j in range(len(a)):
            r = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(r) * np.maximum(np.abs(r) - penalty * n, 0) / max(gram[j, j], 1e-300)
    return w


TRANSITIONS = {"ols": transition_ols, "kabsch": lambda a, b: transition_kabsch(a.T, b.T), "l1": transition_lasso, "orig": transition_pinv}


def logistic_ridge(x: np.ndarray, y: np.ndarray, penalty: float = 10.0, rounds: int = 30, cutoff: float | None = None) -> np.ndarray:
    """Fitted probabilities of a ridge logistic regression (Newton); with a cutoff, coefficients
    whose Wald test has a larger p count as 0."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 0
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        info = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(info, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    if cutoff is not None:
        from netloom.functions.tails import normal_cdf

        se = np.sqrt(np.maximum(np.diag(np.linalg.inv(info)), 1e-300))
        weak = np.array([2 * normal_cdf(-abs(v)) > cutoff for v in b / se])
        weak[0] = False
        b = np.where(weak, 0.0, b)
    return 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))


def _standard(x: np.ndarray) -> np.ndarray:
    """Rows of mean 0 and length 1, or of zeros."""
    z = x - x.mean(1, keepdims=True)
    s = np.sqrt((z * z).sum(1, keepdims=True))
    return np.divide(z, s, out=np.zeros_like(z), where=s > 0)


def direct_evidence(motif: np.ndarray, z: np.ndarray, of_tf: list[int]) -> np.ndarray:
    """Squared correlations of tfs and genes; a tf that is no gene is stood for by its targets' mean."""
    t = np.array([z[k] if k >= 0 else (z[m > 0].mean(0) if (m > 0).any() else np.zeros(z.shape[1])) for m, k in zip(motif, of_tf, strict=True)])
    return (_standard(t) @ z.T) ** 2


def bere(motif: np.ndarray, expr: np.ndarray, alpha: float = 0.5, penalty: float = 10.0, of_tf: list[int] | None = None, cutoff: float | None = None) -> np.ndarray:
    """tfs x genes: (1 - alpha) rank of the squared correlation with the tf + alpha rank of the
    logistic fit of the motif by expression; not ranked where one of the two has no part."""
    from netloom.functions.tails import mean_ranks

    z = _standard(expr)
    direct = direct_evidence(motif, z, of_tf or [-1] * len(motif)) if alpha < 1 else np.zeros(motif.shape)
    fit = np.array([logistic_ridge(z, (m > 0).astype(float), penalty, cutoff=cutoff) for m in motif]) if alpha > 0 else np.zeros(motif.shape)
    rank = (lambda m: mean_ranks(m.ravel()).reshape(m.shape)) if 0 < alpha < 1 else (lambda m: m)
    return (1 - alpha) * rank(direct) + alpha * rank(fit)


def correlation_difference(motif: np.ndarray, expr: np.ndarray) -> np.ndarray:
    """Mean correlation of a gene with a tf's targets minus that with the other genes, over the
    deviation of these differences across tfs."""
    c = correlation(expr)
    inside, outside = motif.sum(1, keepdims=True), (1 - motif).sum(1, keepdims=True)
    d = np.divide(motif, inside, out=np.zeros_like(motif), where=inside != 0) @ c - np.divide(1 - motif, outside, out=np.zeros_like(motif), where=outside != 0) @ c
    sd = d.std(0, ddof=1) if len(d) > 1 else np.ones(d.shape[1])
    return np.divide(d, sd, out=np.zeros_like(d), where=sd > 0)


def motif_network(motif: np.ndarray, expr: np.ndarray, of_tf: list[int], method: str = "bere", alpha: float = 0.5, cutoff: float | None = None, with_motif: bool = False) -> np.ndarray:
    """A network of one condition (tfs x genes) by ``bere``, ``pearson`` or ``cd``; ``with_motif`` lifts
    the prior's edges by the range of the others."""
    if method == "bere":
        out = bere(motif, expr, alpha, of_tf=of_tf, cutoff=cutoff)
        lift = out.max() - out.min()
    elif method == "pearson":
        out = direct_evidence(motif, _standard(expr), of_tf)
        lift = out.max() - out.min()
    else:
        out = correlation_difference(motif, expr)
        lift = out.max()
    return out + lift * motif if with_motif else out


def jutter_degree(strengths: np.ndarray, beta: float, sloped: bool = True, seed: int = 0) -> np.ndarray:
    """Noisy strengths. The noise has a constant part and, if sloped, one in proportion to a strength's
    size, half as large for negative strengths. A negative beta asks for the scale of small networks."""
    if beta == 0:
        return strengths.astype(float)
    # fixed values: slope and constant for small networks and for those of many genes
    slope, constant = (0.06, 1.0) if beta < 0 else (0.025, 400.0)
    beta = abs(beta)
    sigma = np.full(len(strengths), constant * beta)
    if sloped:
        sigma = sigma + np.abs(strengths) * beta * slope * np.where(strengths < 0, 0.5, 1.0)
    return strengths + np.random.default_rng(seed).normal(0, 1, len(strengths)) * sigma


#: Times that a row is drawn back into the range of the network.
PULLS = 150


def _drawn_back(x: np.ndarray, free: np.ndarray, rest: np.ndarray, total: float, lo: float, hi: float) -> np.ndarray:
    """A row x with the given sum over its free places, changed until what it leaves of ``rest`` for
    the next row lies between lo and hi, or as nearly as ``PULLS`` rounds get."""

    def scaled(x: np.ndarray) -> np.ndarray:
        s = x[free].sum()
        return np.where(free, x * (total / s), x) if abs(s) > 1e-12 else np.where(free, x + (total - s) / max(free.sum(), 1), x)

    x = scaled(x)
    for _ in range(PULLS):
        left = rest - x
        off = np.where(free, np.minimum(left - lo, 0) + np.maximum(left - hi, 0), 0.0)
        if not off.any():
            break
        x = scaled(x + off)
    return x


def crane_bipartite(w: np.ndarray, alpha: float = 0.1, beta: float = 0.0, seed: int = 0) -> np.ndarray | None:
    """Perturb a strength network, keeping row and column sums: rows, in random order, get noise
    relative to their deviation and their sum back; what a row's columns then lack goes to the
    next. ``beta`` first makes the strengths of both sides noisy. None if sums can't be kept."""
    r = np.random.default_rng(seed)
    n, m = w.shape
    if n < 2 or m < 2:
        return w.astype(float).copy()
    rows, cols = r.permutation(n), r.permutation(m)
    a = w.astype(float)[np.ix_(rows, cols)]
    if beta:
        a = a + ((jutter_degree(a.sum(1), beta, True, seed) - a.sum(1)) / m)[:, None]
        a = a + (jutter_degree(a.sum(0), beta, False, seed + 1) - a.sum(0)) / n
    strength, lo, hi = a.sum(1), a.min(), a.max()
    free = np.ones(m, bool)
    x = np.zeros_like(a)
    now = a[0]
    for i in range(1, n):
        noisy = now + alpha * r.normal(0, max(now.std(ddof=1), 0.0), m)
        rest = now + a[i]  # what this row and the next have to share
        x[i - 1] = _drawn_back(noisy, free, rest, strength[i - 1], lo, hi)
        now = rest - x[i - 1]
    x[n - 1] = now
    if not (np.allclose(x.sum(1), strength) and np.allclose(x.sum(0), a.sum(0)) and np.isfinite(x).all()):
        return None
    out = np.empty_like(x)
    out[np.ix_(rows, cols)] = x
    return out


def crane_unipartite(a: np.ndarray, alpha: float = 0.1, seed: int = 0, self_loops: bool = False) -> np.ndarray | None:
    """The same for a symmetric network, row by row of its upper half: a row's places right of the
    next node are free. The diagonal stays, or is left out without ``self_loops``."""
    r = np.random.default_rng(seed)
    n = len(a)
    order = r.permutation(n)
    whole = a.astype(float)[np.ix_(order, order)]
    if not self_loops:
        np.fill_diagonal(whole, 0.0)
    u = np.triu(whole)
    strength, lo, hi = u.sum(1), u.min(), u.max()
    x = u.copy()
    now = u[0].copy()
    for i in range(1, n - 1):
        free = np.arange(n) > i
        sd = np.delete(whole[i - 1], i - 1).std(ddof=1)
        noisy = np.where(free, now + alpha * r.normal(0, sd, n), now)
        rest = now + u[i]
        x[i - 1] = _drawn_back(noisy, free, rest, strength[i - 1] - now[~free].sum(), lo, hi) if free.sum() > 1 else now
        now = rest - x[i - 1]
    if n > 1:
        x[n - 2] = now
    x = np.triu(x)
    full = x + np.triu(x, 1).T
    want = u + np.triu(u, 1).T
    if not (np.allclose(full.sum(0), want.sum(0)) and np.isfinite(full).all()):
        return None
    out = np.empty_like(full)
    out[np.ix_(order, order)] = full
    return out


def classical_scaling(d: np.ndarray, k: int = 2) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1 / n
    val, vec = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(val)[::-1][:k]
    return vec[:, order] * np.sqrt(np.maximum(val[order], 0))


def complete_linkage(d: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by complete-linkage agglomeration, numbered by first appearance."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    member = {i: [i] for i in range(len(d))}
    while len(member) > max(k, 1):
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        member[i] += member.pop(j)
    label = np.zeros(len(d), int)
    for c, rows in enumerate(sorted(member.values(), key=min), 1):
        label[rows] = c
    return label


def tiger(expr: np.ndarray, prior: np.ndarray, rounds: int = 300, signed: bool = True, noise: float = 1.0, baseline: bool = True):
    """expr (genes x samples) ~ w z + b by mean-field coordinate updates (posterior means): weights
    only on the prior's support (tfs x genes) with its signs, activities not negative."""
    support = prior.T != 0
    sign = np.sign(prior.T)
    b = expr.mean(1, keepdims=True) if baseline else np.zeros((len(expr), 1))
    x = expr - b
    r = np.random.default_rng(0)
    w = np.where(support, np.where(sign == 0, 1, sign) * 0.1, 0.0)
    z = np.abs(r.normal(1, 0.1, (prior.shape[0], expr.shape[1])))
    for _ in range(rounds):
        old = w.copy()
        res = x - w @ z
        for t in range(len(z)):
            res += np.outer(w[:, t], z[t])
            z[t] = np.maximum(w[:, t] @ res / (w[:, t] @ w[:, t] + noise * 0.1), 0)
            new = res @ z[t] / (z[t] @ z[t] + noise * 0.1)
            if signed:
                new = np.where(new * sign[:, t] >= 0, new, 0.0)
            w[:, t] = np.where(support[:, t], new, 0.0)
            res -= np.outer(w[:, t], z[t])
        if np.abs(w - old).max() < 1e-7:
            break
    return {"W": w, "Z": z, "b": b[:, 0]}


def enrichment_score(order: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> float:
    """Running-sum enrichment score of a ranked list."""
    h = hits[order]
    w = np.abs(weight[order]) * h
    if not h.any() or h.all() or not w.sum():
        return 0.0
    run = np.cumsum(w / w.sum() - ~h / (~h).sum())
    return float(run[np.argmax(np.abs(run))])
