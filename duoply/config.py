"""Every rule constant, in one place. Results depend on them."""

SUPPORT_CAP = 1.5
DEFAULT_TOP, DEFAULT_ALTERNATIVE = 0.9, 0.1
POOL_SIZE = 10
NEAR_TIE, NEAR_TIE_CONF, CLASH_CONF = 0.15, 0.45, 0.45
CONSENSUS_EACH, CONSENSUS_SUM = 0.15, 1.0
RELIABLE_RATE, RELIABLE_PLIES = 0.40, 8
STRUCTURED_CAP = 2.0
#: target square, rank, file, piece, shared moves
STRUCTURED_WEIGHTS = (0.40, 0.30, 0.10, 0.05, 0.15)
SHIFT_RANGE, SHIFT_LEAST, SHIFT_GAIN = 5, 5, 0.2
DROP_WINDOW, DROP_BELOW = 8, 0.3
DROPOUT_BELOW, DROPOUT_ANCHOR, DROPOUT_ANCHORS, DROPOUT_LENGTH = 0.25, 0.90, 4, (2, 6)
RUN_LEAST, RUN_STRONG, STRONG_RATIO = 4, 3, 0.4
ATTENTION_SECONDS = 120
NEUTRAL_SIMILARITY = 0.474
GAP_COST, MATCH_BIAS = -0.3, -0.05
#: readings that count as seen, as sure, as surest
SEEN_CONF, SURE_CONF, SUREST_CONF = 0.5, 0.70, 0.85
#: anchors of a gap, and of a gap of one ply with the matches that are looked at
ANCHOR, SINGLE_ANCHOR, SINGLE_SCAN = 0.5, 1.5, 3
#: where readings part: rows before and after that are aligned, largest difference of lengths, most issues, most edits applied
ALIGN_BACK, ALIGN_AHEAD, SILENT_TAIL, MOST_ISSUES, MOST_APPLIES = 6, 20, 6, 30, 20
#: repeated rows near a point: reach, overlaps of both halves, piece and file
REPEAT_REACH, REPEAT_WHITE, REPEAT_BLACK, REPEAT_STRUCTURED = 10, 0.8, 0.4, 3.2
#: repeated rows anywhere: overlaps of both halves, piece, file
ROWS_WHITE, ROWS_BLACK, ROWS_PIECE, ROWS_FILE = 0.6, 0.3, 1.6, 1.6
SHORTEST_SHEET, WEAK_SHIFT = 6, 0.4
CTC_WEIGHT, CTC_ABSTAIN, PRIOR_WEIGHT = 3.0, -19.27, 10.0
#: column geometry of sheets: cluster gap and least cells, samples kept and needed, width of an aspect bucket
COLUMN_GAP, CLUSTER_CELLS, SAMPLES_KEPT, SAMPLES_NEEDED, ASPECT_STEP = 0.025, 4, 15, 3, 0.1
#: rows of two sheets, in pixels: cluster gap, largest mean deviation, largest difference of counts
ROW_GAP, ROW_DEVIATION, ROW_COUNTS = 10.0, 15.0, 2
#: weights of the components of a fix's score; those without a number here count as they are
SCORE_WEIGHTS = {"similarity": 40.0, "conf": 15.0, "completes": 5.0, "low_conf": 10.0, "ambiguous": 10.0, "zero_reach": -1.0, "distance": -1.0, "absurdity": -1.0, "hanging": -1.0, "pawn_hanging": -1.0, "missed_capture": -1.0, "opponent_capture": -1.0, "record_break": 0.0}
#: evidence that a search may add to the score as it is (columns of fixes, where they are there)
SCORE_INPUTS = ("future_capture", "future_moves", "winning_capture", "check", "clears_square", "nearest", "hanging", "pawn_hanging", "missed_capture", "opponent_capture", "record_break")
#: similarity from which a fix without reach loses so much
ZERO_REACH = ((0.95, 5), (0.90, 15), (0.80, 25), (0.70, 32), (0.0, 40))
METHOD_ORDER = ("dijkstra", "beam", "greedy")
#: confusable pieces
CONFUSABLE = (("R", "K"), ("B", "R"), ("N", "K"), ("B", "N"))
