"""Emission lines, class codes, grids, selection bits."""

from __future__ import annotations

# Emission lines, in declared order (the position is meaningful).
# LINE, WAVE, START, END, BLUE_START, BLUE_END, RED_START, RED_END (Angstrom)
LINES: tuple[tuple, ...] = (
    ("lyb", 1033.03, 1023.0, 1041.0, 998.0, 1014.0, 1050.0, 1100.0),
    ("lya", 1215.67, 1194.0, 1250.0, 1103.0, 1159.0, 1285.0, 1341.0),
    ("siiv", 1396.76, 1377.0, 1417.0, 1346.0, 1370.0, 1432.0, 1497.0),
    ("civ", 1549.06, 1515.0, 1575.0, 1449.5, 1494.5, 1603.0, 1668.0),
    ("civ_blue", 1549.06, 1515.0, 1549.06, 1449.5, 1494.5, 1603.0, 1668.0),
    ("civ_red", 1549.06, 1549.06, 1575.0, 1449.5, 1494.5, 1603.0, 1668.0),
    ("ciii", 1908.73, 1880.0, 1929.0, 1756.0, 1845.0, 1964.0, 2053.0),
    ("neiv", 2423.83, 2410.0, 2435.0, 2365.0, 2400.0, 2450.0, 2480.0),
    ("mgii", 2798.75, 2768.0, 2816.0, 2610.0, 2743.0, 2851.0, 2984.0),
    ("nev", 3426.84, 3415.0, 3435.0, 3375.0, 3405.0, 3445.0, 3480.0),
    ("oii", 3728.48, 3720.0, 3745.0, 3650.0, 3710.0, 3750.0, 3790.0),
    ("hb", 4862.68, 4800.0, 4910.0, 4700.0, 4770.0, 5030.0, 5105.0),
    ("oiii", 5008.24, 4990.0, 5020.0, 4700.0, 4770.0, 5030.0, 5105.0),
    ("ha", 6564.61, 6480.0, 6650.0, 6320.0, 6460.0, 6750.0, 6850.0),
)
LINE_COLUMNS = ("LINE", "WAVE", "START", "END", "BLUE_START", "BLUE_END",
                "RED_START", "RED_END")

# Lines tried as the origin of a peak, in order.
TRY_LINES: tuple[str, ...] = ("lya", "civ", "ciii", "mgii", "hb", "ha")

# Class codes.
STAR, QUASAR, GALAXY, BAL_QUASAR = 1, 3, 4, 30
QUASAR_CLASSES = (QUASAR, BAL_QUASAR)
# Training class of an object whose trial redshift is wrong.
WRONG_REDSHIFT_CLASS = {30: 305, 3: 35, 4: 45}
# Every class label, in numeric order (the order breaks ties).
CLASS_LABELS = (1, 3, 4, 30, 35, 45, 305)

# Defaults of the jobs.
SPLIT_REDSHIFT = 2.1
REDSHIFT_TOLERANCE = 0.15
MISSING_FEATURE = -9999.99
SKY_MARGIN = 1.5e-4
PEAK_WIDTH, PEAK_MIN_SIGNIFICANCE = 70.0, 6.0
POWER_LAW_MIN_SIGNIFICANCE = 2.0
NUM_PIXELS = 30
REBIN_CENTER = 4000.0
RANDOM_STATE = 2081487193
NUM_TREES, MAX_DEPTH = 1000, 10

# Pixel centres dropped with 100 A bins, per filter tray layout.
TRAY_WAVES = {
    "standard": (3900.0, 4000.0, 4300.0, 4400.0, 4700.0, 4800.0, 5100.0, 5200.0),
    "alternative": (3800.0, 4000.0, 4200.0, 4400.0, 4600.0, 4800.0, 5000.0, 5200.0),
}
TRAY_MAX_WAVE = 7300.0

# Target selection bits of a confident quasar.
BOSS_TARGET1_BITS = (10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 40, 41, 42, 43, 44)
EBOSS_TARGET0_BITS = (10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 30, 31, 33,
                      34, 35, 40)

# Photometric filters of the first two trays, by position.
TRAY_FILTERS = (0, 3, 5, 7, 9, 11, 14, 16, 18, 19, 20, 21, 22, 23, 24, 25, 26,
                27, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38)



def stepped(start: float, stop: float, step: float) -> list[float]:
    """``start + i*step`` while on the near side of ``stop`` (as numpy.arange)."""
    import numpy as np

    return [float(v) for v in np.arange(start, stop, step)]


# Probability grid of the threshold sweep, probability cuts of the
# report, significance cuts of the peak finder study, velocity histogram edges.
PROB_GRID = stepped(1.0, 0.0, -0.01)
REPORT_CUTS = stepped(0.9, 0.0, -0.05)
SIGNIFICANCE_CUTS = stepped(0.0, 10.0, 0.1)
VELOCITY_EDGES = stepped(-2e4, 2e4, 750.0)
# Fixed value: speed of light in km/s as used by the velocity statistics.
LIGHT_SPEED = 3e5
