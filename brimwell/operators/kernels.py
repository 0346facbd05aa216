"""Filters of one trace as numpy functions; operators apply them trace by trace in Spark tasks."""

from __future__ import annotations

import numpy as np


def mirrored(x: np.ndarray, n: int) -> np.ndarray:
    """x with n samples before and behind, mirrored with the edge sample repeated."""
    place = np.arange(-n, len(x) + n) % (2 * len(x))
    return x[np.where(place < len(x), place, 2 * len(x) - 1 - place)]


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, cut at four sigma, mirrored edges."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(mirrored(x, r), w / w.sum(), "valid")


def polynomial_removed(x: np.ndarray, order: int) -> np.ndarray:
    """x minus its least-squares polynomial; a short trace takes a lower order."""
    t = np.arange(len(x))
    return x - np.polynomial.Polynomial.fit(t, x, min(order, len(x) - 1))(t) if len(x) > 1 else x - x


def butterworth(order: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients (b, a) by the bilinear transform; share is the cut-off over half the sampling rate."""
    warped = 4 * np.tan(np.pi * share / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def windowed_sinc(taps: int, share: float) -> np.ndarray:
    """Low-pass taps with a Hamming window, of sum 1."""
    n = np.arange(taps) - (taps - 1) / 2
    w = share * np.sinc(share * n) * np.hamming(taps)
    return w / w.sum()


def recursion(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The filter b / a as a step (A, B, D) of a state s: y = s[0] + D * x, then s becomes A s + B x."""
    size = max(len(a), len(b))
    b, a = np.pad(b, (0, size - len(b))) / a[0], np.pad(a, (0, size - len(a))) / a[0]
    step = np.eye(size - 1, k=1)
    step[:, :1] -= a[1:, None]
    return step, b[1:] - a[1:] * b[0], float(b[0])


def steady(system: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """The state that an input of ones keeps."""
    step, drive, _ = system
    return np.linalg.solve(np.eye(len(drive)) - step, drive) if len(drive) else drive


def _responses(step: np.ndarray, n: int) -> np.ndarray:
    """(n, order): what each state gives at times 0, 1, ... without input."""
    out, row = np.empty((n, len(step))), np.eye(1, len(step))[0]
    for t in range(n):
        out[t] = row
        row = row @ step
    return out


def driven(system: tuple[np.ndarray, np.ndarray, float], x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and end state.  Stretches of about sqrt(n) samples are filtered side by side from a state of nought, then the states they begin in are added."""
    step, drive, direct = system
    if not len(drive) or not len(x):
        return direct * x, state
    long = max(1, int(np.sqrt(len(x))))
    rows = len(x) // long
    main = x[: rows * long].reshape(rows, long).T.copy()
    s, y = np.zeros((len(drive), rows)), np.empty((long, rows))
    for t in range(long):
        y[t] = s[0] + direct * main[t]
        s = step @ s + drive[:, None] * main[t]
    free, over = _responses(step, long), np.linalg.matrix_power(step, long)
    begun = np.empty((len(drive), rows))
    for k in range(rows):
        begun[:, k] = state
        state = over @ state + s[:, k]
    out = [(y + free @ begun).T.ravel()]
    for v in x[rows * long :]:
        out.append(np.array([state[0] + direct * v]))
        state = step @ state + drive * v
    return np.concatenate(out), state


def echo(system: tuple[np.ndarray, np.ndarray, float], n: int) -> np.ndarray:
    """The end state of the backward pass over n samples as a matrix times the state in which the forward pass began without input."""
    step, drive, _ = system
    out, power = np.zeros((len(drive), len(drive))), np.eye(len(drive))
    total = np.outer(drive, np.eye(1, len(drive))[0])  # the sum over t of A^t B e0 A^t, by doubling
    while n:
        if n & 1:
            out, power = out + power @ total @ power, power @ step
        total, step, n = total + step @ total @ step, step @ step, n >> 1
    return out


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass of the filter b / a, begun in the steady state of x[0]."""
    if not np.any(a[1:]):
        return np.convolve(np.concatenate([np.full(len(b) - 1, x[0]), x]), b / a[0], "valid")
    system = recursion(b, a)
    return driven(system, x, steady(system) * x[0])[0]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter run forward and backward, edges padded by odd reflection."""
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    if pad < 1:
        return x
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return filtered(b, a, filtered(b, a, wide)[::-1])[::-1][pad : pad + len(x)]


def overlap_save(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places where all taps meet samples: by transforms over overlapping stretches, of which the wrapped ends are dropped."""
    k = len(taps)
    size = 1 << max(10, int(np.ceil(np.log2(8 * k))))
    if len(x) <= size:
        return np.convolve(x, taps, "valid")
    step, spectrum = size - k + 1, np.fft.rfft(taps, size)
    n = len(x) - k + 1
    wide = np.append(x, np.zeros(-n % step))
    rows = np.lib.stride_tricks.sliding_window_view(wide, size)[::step]
    return np.fft.irfft(np.fft.rfft(rows, axis=1) * spectrum, size, axis=1)[:, k - 1 :].ravel()[:n]


def centred_mean(x: np.ndarray, half: int) -> np.ndarray:
    """Mean of the known values among `half` places to each side; NaN where there is none."""
    known = ~np.isnan(x)
    out, n = np.zeros(len(x)), np.zeros(len(x))
    for d in range(-half, half + 1):  # place by place, so that no running sum loses digits
        low, high = max(0, -d), min(len(x), len(x) - d)
        if low < high:
            out[low:high] += np.where(known, x, 0.0)[low + d : high + d]
            n[low:high] += known[low + d : high + d]
    return np.where(n > 0, out / np.maximum(n, 1), np.nan)


def diffused(x: np.ndarray, times: int, kappa: float, gamma: float, option: int) -> np.ndarray:
    """Edge-preserving diffusion: x += gamma * (m - m before), m = g(d) * d of the step d to the next sample; beside NaN there is no step."""
    for _ in range(times):
        d = np.nan_to_num(np.append(np.diff(x), 0.0)) if len(x) else x
        r = d / kappa if kappa else np.zeros(len(x))
        if option == 1:
            g = np.exp(-r * r)
        elif option == 2:
            g = 1 / (1 + r * r)
        else:
            g = np.where(r * r / 2 <= 1, (1 - r * r / 2) ** 2 / 2, 0.0)
        m = g * d
        x = x + gamma * (m - np.append(0.0, m[:-1])) if len(x) else x
    return x
