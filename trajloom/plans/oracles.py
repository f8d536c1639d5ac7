"""The registered queries as SQL for another engine, written from the definitions."""

from __future__ import annotations

from trajloom.functions.templates import TEMPLATES

# --- Shared parts -------------------------------------------------------------

PAIRS = """
turns AS (
  SELECT conv_id, turn, role, text,
    LAG(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
    LAG(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
  FROM conversations),
pairs AS (
  SELECT conv_id || ':' || turn AS traj_id, conv_id AS group_id, turn,
    prev_text AS prompt, text AS response
  FROM turns WHERE role = 'assistant' AND prev_role = 'user')"""

ADVANTAGE = """CASE WHEN MIN(reward) OVER g = MAX(reward) OVER g THEN 0.0E0
    ELSE (reward - AVG(reward) OVER g) / (STDDEV_POP(reward) OVER g + 1.0E-6) END"""

TEXT = PAIRS + f""",
rewarded AS (
  SELECT *, CASE WHEN length(response) % 3 = 0 THEN 1.0E0 ELSE 0.0E0 END AS reward,
    length(response) * 0.35E0 AS nll_seq FROM pairs),
advantaged AS (
  SELECT *, {ADVANTAGE} AS full_advantage
  FROM rewarded WINDOW g AS (PARTITION BY group_id)),
trajectories AS (
  SELECT traj_id, group_id, turn, prompt, response, reward, nll_seq,
    CASE WHEN length(response) % 19 <> 0 THEN full_advantage END AS advantage,
    CASE WHEN length(response) % 17 = 0 THEN NULL
      WHEN full_advantage < 0 AND length(response) % 11 = 0 THEN ' Negative '
      WHEN full_advantage < 0 THEN 'negative' ELSE 'positive' END AS origin_label,
    -(length(response) * 0.35E0) + ((length(response) % 13) - 6) * 0.5E0 AS policy_logps,
    greatest(floor(length(response) / 4.0E0), 1.0E0) AS completion_len
  FROM advantaged)"""

NUMERIC = """
numbers AS (
  SELECT l_orderkey * 10 + l_linenumber AS traj_id, l_orderkey AS group_id, l_linenumber,
    l_quantity * 1.5E0 AS nll_seq,
    CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS origin_label,
    -l_quantity * 1.5E0 + (l_tax - 0.04E0) * 50.0E0 AS policy_logps,
    CAST(l_quantity AS DOUBLE) AS completion_len,
    CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_discount - 0.05E0 END AS advantage
  FROM lineitem)"""

EVENTS = """
feed AS (
  SELECT event_id AS traj_id, ts, user_id AS group_id, value / 3.0E0 + 1.0E0 AS nll_seq,
    CASE WHEN event_type = 'error' THEN 'negative' ELSE 'positive' END AS origin_label,
    CASE WHEN event_type <> 'view' THEN value / 90.0E0 - 1.0E0 END AS advantage,
    -(value / 3.0E0 + 1.0E0) + (length(event_type) - 5) * 0.5E0 AS policy_logps,
    greatest(floor(value / 4.0E0), 1.0E0) AS completion_len
  FROM events)"""


def r6(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0E0"


def rounded(names: list[str]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


def losses(
    source: str,
    alpha: float = 1.0,
    clip: float = 10.0,
    norm: bool = False,
    use_advantage: bool = True,
    default: float = 1.0,
    carry: str = "",
) -> str:
    """CTEs up to ``losses``; negative origin is read from the trimmed label text."""
    by = "completion_len" if norm else "1.0E0"
    gain = f"coalesce(advantage, {default}E0)" if use_advantage else f"{default}E0"
    return f"""
flagged AS (
  SELECT traj_id, {carry} policy_logps, completion_len,
    coalesce(-nll_seq, 0.0E0) AS old_logps, {gain} AS advantage_used,
    CASE WHEN lower(trim(origin_label)) = 'negative' THEN 1.0E0 ELSE 0.0E0 END AS origin_is_negative,
    policy_logps / {by} AS pol, coalesce(-nll_seq, 0.0E0) / {by} AS old
  FROM {source}),
ratios AS (SELECT *, exp(least(pol - old, ln({clip}E0))) AS ratio FROM flagged),
weights AS (
  SELECT *, least(greatest(ratio, 0.0E0), {alpha}E0) AS w,
    CASE WHEN origin_is_negative > 0.5E0 THEN least(greatest(ratio, 0.0E0), {alpha}E0)
      ELSE 1.0E0 END AS weight FROM ratios),
losses AS (
  SELECT *, -advantage_used * weight AS coef, -advantage_used * weight * pol AS loss,
    (policy_logps - old_logps) / completion_len AS reward,
    CASE WHEN ratio >= {alpha}E0 THEN 1 ELSE 0 END AS capped FROM weights)"""


LOSS = ["ratio", "w", "weight", "coef", "loss", "reward"]


def metric_list(norm: bool = False, prefix: str = "") -> str:
    means = {
        "rewards_chosen": "reward", "logps_chosen": "policy_logps", "ratio_mean": "ratio",
        "w_mean": "w", "weight_mean": "weight", "loss": "loss",
        "completion_len_mean": "completion_len", "old_logp_mean": "old_logps",
        "data_advantage_mean": "advantage_used", "frac_capped": "capped",
        "frac_origin_negative": "CASE WHEN origin_is_negative > 0.5E0 THEN 1 ELSE 0 END",
    }
    parts = [f"{r6(f'AVG({source})')} AS {prefix}{name}" for name, source in means.items()]
    parts.append(f"{1.0 if norm else 0.0}E0 AS {prefix}length_normalize")
    return ", ".join(["COUNT(*) AS samples", *parts])


def sample_loss(**options) -> str:
    return f"""WITH {NUMERIC}, {losses("numbers", **options)}
SELECT traj_id, {rounded(["old_logps", "advantage_used", *LOSS])}, CAST(capped AS BIGINT) AS capped
FROM losses"""


def template(name: str) -> str:
    return f"""WITH {PAIRS}
SELECT traj_id, {rendered(name)} AS prompt, response FROM pairs"""


def rendered(name: str) -> str:
    before, after = TEMPLATES[name].split("{instruction}")
    return f"'{before}' || prompt || '{after}'"


# --- Tokens -------------------------------------------------------------------

PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def words(source: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT traj_id, {i} AS field, unnest(regexp_extract_all({c}, '{PATTERN}')) AS word,
    unnest(range(len(regexp_extract_all({c}, '{PATTERN}')))) AS pos FROM {source}"""
        for i, c in enumerate(columns)
    ]
    return "words AS (" + " UNION ALL ".join(parts) + ")"


def vocabulary(where: str = "") -> str:
    return f"""
vocabulary AS (
  SELECT word, COUNT(*) AS n,
    3 + ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, word) AS token_id
  FROM words {where} GROUP BY word)"""


def coded(source: str) -> str:
    return f"""
coded AS (
  SELECT s.traj_id,
    coalesce(list(coalesce(token_id, 1) ORDER BY pos) FILTER (WHERE field = 0), []) AS p,
    coalesce(list(coalesce(token_id, 1) ORDER BY pos) FILTER (WHERE field = 1), []) AS r
  FROM {source} s LEFT JOIN words USING (traj_id) LEFT JOIN vocabulary USING (word)
  GROUP BY s.traj_id)"""


def inputs(max_length: int = 1024, max_prompt: int = 512, start: bool = False, bos: bool = True) -> str:
    """From ``coded`` to ``tokens`` (traj_id, ids, labels)."""
    whole = "list_concat([2], p)" if bos else "p"
    cut = f"q[1:{max_prompt}]" if start else f"q[-{max_prompt}:]"
    return f"""
begun AS (SELECT traj_id, r, {whole} AS q FROM coded),
prompted AS (SELECT traj_id, r, CASE WHEN len(q) > {max_prompt} THEN {cut} ELSE q END AS q FROM begun),
tokens AS (
  SELECT traj_id, len(q) AS prompt_len, len(r) AS response_len,
    list_concat(q, r)[1:{max_length}] AS ids,
    list_concat(list_transform(q, lambda x: -100), r)[1:{max_length}] AS labels
  FROM prompted)"""


def text_tokens(**options) -> str:
    return f"""{TEXT},
rendered AS (SELECT traj_id, {rendered("ours")} AS prompt, response FROM trajectories),
{words("rendered", ["prompt", "response"])}, {vocabulary()}, {coded("rendered")}, {inputs(**options)}"""


def shown(lst: str) -> str:
    return f"coalesce(array_to_string({lst}, ' '), '')"


def model_inputs(**options) -> str:
    return f"""WITH {text_tokens(**options)}
SELECT traj_id, {shown("ids")} AS input_ids, {shown("list_transform(ids, lambda x: 1)")} AS attention_mask,
  {shown("labels")} AS labels FROM tokens"""


LIMITS = {"max_length": 256, "max_prompt": 96}

SCORED = """
cells AS (
  SELECT traj_id, unnest(range(len(ids))) AS pos, unnest(labels) AS token,
    unnest(list_concat([NULL], ids[1:-2])) AS prev
  FROM tokens),
scored AS (SELECT * FROM cells WHERE pos >= 1 AND token <> -100)"""

UNIGRAM = """
unigrams AS (SELECT token, CAST(COUNT(*) AS DOUBLE) AS n FROM scored GROUP BY token),
size AS (SELECT CAST(COUNT(*) AS DOUBLE) AS v FROM vocabulary),
mass AS (SELECT SUM(n) AS total FROM unigrams),
unigram_scores AS (
  SELECT traj_id, pos, token, ln((n + 1) / (total + v)) AS token_logp
  FROM scored JOIN unigrams USING (token), size, mass)"""

BIGRAM = """
bigrams AS (SELECT prev, token, CAST(COUNT(*) AS DOUBLE) AS n FROM scored GROUP BY prev, token),
contexts AS (SELECT prev, SUM(n) AS total FROM bigrams GROUP BY prev),
bigram_size AS (SELECT CAST(COUNT(*) AS DOUBLE) AS v FROM vocabulary),
bigram_scores AS (
  SELECT traj_id, pos, token, ln((n + 1) / (total + v)) AS token_logp
  FROM scored JOIN bigrams USING (prev, token) JOIN contexts USING (prev), bigram_size)"""


def sequences(name: str, scores: str) -> str:
    return f"""
{name} AS (
  SELECT t.traj_id, coalesce(SUM(token_logp), 0.0E0) AS policy_logps,
    CAST(greatest(COUNT(token_logp), 1) AS DOUBLE) AS completion_len,
    COUNT(token_logp) AS scored_tokens
  FROM tokens t LEFT JOIN {scores} USING (traj_id) GROUP BY t.traj_id)"""


def score(table: str, ctes: str) -> str:
    return f"""WITH {text_tokens()}, {SCORED}, {ctes}, {sequences("sequences", table)}
SELECT traj_id, {rounded(["policy_logps", "completion_len"])}, scored_tokens FROM sequences"""


# --- Batches ------------------------------------------------------------------


def assignment(source: str, id_col: str, per: int = 4, procs: int = 4, accum: int = 8, epochs: int = 2) -> str:
    size = per * procs
    return f"""
ordered AS (
  SELECT {id_col}, CAST(epoch AS INTEGER) AS epoch,
    ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || {id_col})) - 1 AS position,
    COUNT(*) OVER (PARTITION BY epoch) AS total
  FROM {source}, range({epochs}) AS e(epoch)),
placed AS (
  SELECT {id_col}, epoch, position, position // {size} AS batch_id,
    (position % {size}) // {per} AS rank, position // {size * accum} AS step_id,
    epoch * CAST(ceil(total / {size * accum}.0E0) AS BIGINT) + position // {size * accum} AS global_step
  FROM ordered)"""


PLACE = "epoch, position, batch_id, rank, step_id, global_step"


def update_step(i: int, theta: str, norm: bool = False, carry_loss: str = "trajectories") -> str:
    """One gradient step from table ``theta`` to ``theta_{i}``."""
    by = "completion_len" if norm else "1.0E0"
    return f"""
z{i} AS (SELECT MAX(theta) + ln(SUM(exp(theta - (SELECT MAX(theta) FROM {theta})))) AS z FROM {theta}),
soft{i} AS (SELECT token, theta, theta - z AS token_logp FROM {theta}, z{i}),
logp{i} AS (SELECT traj_id, token, token_logp FROM scored JOIN soft{i} USING (token)),
{sequences(f"seq{i}", f"logp{i}")},
coef{i} AS (
  SELECT traj_id, -coalesce(advantage, 1.0E0)
    * CASE WHEN lower(trim(origin_label)) = 'negative'
        THEN least(exp(least((s.policy_logps + nll_seq) / {by.replace("completion_len", "s.completion_len")}, ln(10.0E0))), 1.0E0) ELSE 1.0E0 END
    / {by.replace("completion_len", "s.completion_len")} AS coef
  FROM {carry_loss} t JOIN seq{i} s USING (traj_id)),
mass{i} AS (SELECT token, SUM(coef) AS a FROM scored JOIN coef{i} USING (traj_id) GROUP BY token),
whole{i} AS (SELECT (SELECT SUM(a) FROM mass{i}) AS s, (SELECT COUNT(*) FROM coef{i}) AS b),
grad{i} AS (
  SELECT token, theta, (coalesce(a, 0.0E0) - exp(token_logp) * s) / b AS gradient
  FROM soft{i} LEFT JOIN mass{i} USING (token), whole{i}),
theta_{i} AS (SELECT token, theta - 0.1E0 * gradient AS theta FROM grad{i})"""


THETA = """theta_0 AS (
  SELECT token_id AS token, ln(coalesce(n, 0.0E0) + 1) AS theta
  FROM (SELECT token_id FROM vocabulary) LEFT JOIN unigrams ON token = token_id)"""

ENRICHED = f"""WITH {TEXT}
SELECT traj_id, {r6("-nll_seq")} AS old_logps, {r6("coalesce(advantage, 1.0E0)")} AS advantage,
  CASE WHEN lower(trim(origin_label)) = 'negative' THEN 1.0E0 ELSE 0.0E0 END AS origin_is_negative
FROM trajectories"""


def policy_update(norm: bool = False) -> str:
    return f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}, {THETA}, {update_step(1, "theta_0", norm)}
SELECT CAST(token AS BIGINT) AS token, {rounded(["theta", "gradient"])},
  {r6("theta - 0.1E0 * gradient")} AS new_theta FROM grad1"""


MIXED = f"""{TEXT}, {NUMERIC}, {EVENTS},
mixed AS (
  SELECT 'text' AS domain, traj_id, prompt, nll_seq, origin_label, advantage, policy_logps, completion_len
  FROM trajectories
  UNION ALL SELECT 'numeric', CAST(traj_id AS VARCHAR), NULL, nll_seq, origin_label, advantage,
    policy_logps, completion_len FROM numbers
  UNION ALL SELECT 'events', CAST(traj_id AS VARCHAR), NULL, nll_seq, origin_label, advantage,
    policy_logps, completion_len FROM feed)"""

SOURCE = f"""WITH {TEXT}
SELECT traj_id, prompt, response, {rounded(["nll_seq", "advantage"])}, origin_label FROM trajectories"""

BATCH_METRICS = f"""{TEXT}, {losses("trajectories")}, {assignment("trajectories", "traj_id")},
per_batch AS (
  SELECT epoch, global_step, step_id, batch_id, rank, {metric_list()}
  FROM losses JOIN placed USING (traj_id) GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "sample_loss": sample_loss(),
    "sample_loss_length_norm": sample_loss(norm=True),
    "sample_loss_alpha5": sample_loss(alpha=5.0),
    "sample_loss_default_adv": sample_loss(use_advantage=False, default=2.0),
    "global_metrics": f"WITH {NUMERIC}, {losses('numbers')} SELECT {metric_list()} FROM losses",
    "global_metrics_length_norm": f"""WITH {NUMERIC}, {losses("numbers", norm=True)}
SELECT {metric_list(norm=True)} FROM losses""",
    "metrics_by_label": f"""WITH {NUMERIC}, {losses("numbers", carry="origin_label,")}
SELECT origin_label, {metric_list()} FROM losses GROUP BY origin_label""",
    "metrics_of_text": f"WITH {TEXT}, {losses('trajectories')} SELECT {metric_list()} FROM losses",
    "metrics_rollup": f"""WITH {MIXED}, {losses("mixed", carry="domain,")},
named AS (SELECT *, CASE WHEN origin_is_negative > 0.5E0 THEN 'negative' ELSE 'positive' END AS origin FROM losses)
SELECT domain, origin, GROUPING(domain, origin) AS level, {metric_list()}
FROM named GROUP BY ROLLUP (domain, origin)""",
    "eval_metrics": f"""WITH {NUMERIC}, {losses("numbers", carry="origin_label,")}
SELECT origin_label, {metric_list(prefix="eval_")} FROM losses GROUP BY origin_label""",
    "expert_mix": f"""WITH {MIXED}
SELECT domain, COUNT(*) AS samples, COUNT(prompt) AS prompts, COUNT(advantage) AS advantages,
  round(SUM(nll_seq), 4) AS nll_sum FROM mixed GROUP BY domain""",
    "mixed_by_ratio": """WITH n AS (SELECT COUNT(*) // 60 * 6 AS total FROM events),
shares AS (SELECT 'click' AS domain, total * 3 // 6 AS quota FROM n UNION ALL SELECT 'view', total * 2 // 6 FROM n
  UNION ALL SELECT 'purchase', total // 6 FROM n),
ranked AS (SELECT event_id, value, event_type AS domain,
  row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_type || ':' || event_id)) AS k FROM events)
SELECT event_id, value, domain FROM ranked JOIN shares USING (domain) WHERE k <= quota""",
    "asof_policy": """SELECT l.event_id, l.user_id, l.ts, r.ts AS policy_valid_from, r.event_id AS policy_version
FROM (SELECT * FROM events WHERE event_type <> 'signup') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "interval_steps": """WITH steps AS (SELECT event_id AS step_id, user_id, ts AS step_start,
  ts + to_hours(CASE WHEN event_id % 50 = 0 THEN 9600 ELSE CAST(ceil(value) AS BIGINT) END) AS step_end
  FROM events WHERE event_type = 'signup')
SELECT step_id, event_id FROM events e JOIN steps s ON e.user_id = s.user_id AND step_start <= ts AND ts < step_end
WHERE event_type <> 'signup'""",
    "session_trajectories": """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value)),
numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS session FROM marked)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS rows, round(SUM(value), 4) AS reward
FROM numbered GROUP BY user_id, session""",
    "origin_flag_string": f"""WITH {TEXT}
SELECT traj_id, origin_label,
  CASE WHEN lower(trim(origin_label)) = 'negative' THEN 1.0E0 ELSE 0.0E0 END AS origin_is_negative
FROM trajectories""",
    "origin_flag_numeric": """SELECT doc_id AS traj_id,
  coalesce(CAST(toxic AS DOUBLE), 0.0E0) AS origin_is_negative FROM labels""",
    "lenient_nll": f"""WITH {NUMERIC},
gaps AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN nll_seq END AS nll_seq) FROM numbers),
{losses("gaps")} SELECT traj_id, {rounded(["old_logps", *LOSS])} FROM losses""",
    "advantage_default": f"""WITH {TEXT}
SELECT traj_id, {r6("coalesce(round(advantage, 3), 0.25E0)")} AS advantage FROM trajectories""",
    "template_alpaca": template("alpaca"),
    "template_math": template("deepseek-math"),
    "template_boxed": template("qwen2-boxed"),
    "template_default": template("ours"),
    "distinct_rollup": """SELECT lang AS domain, source AS label, CAST(GROUPING(lang, source) AS BIGINT) AS level,
  COUNT(*) AS samples, COUNT(DISTINCT text) AS prompts FROM documents GROUP BY ROLLUP (lang, source)""",
    "delta_metrics": f"""WITH {NUMERIC.replace("FROM lineitem", "FROM lineitem WHERE l_shipdate >= TIMESTAMP '1993-01-01'")},
revised AS (SELECT * REPLACE (CASE WHEN completion_len >= 40 THEN advantage / 2 ELSE advantage END AS advantage) FROM numbers),
{losses("revised", carry="origin_label,")}
SELECT origin_label, {metric_list()} FROM losses GROUP BY origin_label""",
    "stream_pairs": f"""WITH {PAIRS} SELECT traj_id, group_id, turn, prompt, response FROM pairs""",
    "stream_late_rows": """WITH first AS (SELECT max(ts) - INTERVAL 5 DAYS AS bound FROM events WHERE event_id % 5 <> 0)
SELECT event_id, CAST(0 AS BIGINT) AS batch, 'kept' AS fate FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 1, CASE WHEN ts < bound THEN 'late' WHEN event_id % 5 = 1 THEN 'repeated' ELSE 'kept' END
FROM events, first WHERE event_id % 5 <= 1""",
    "replay_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "replay_pairs_sparse": f"""WITH {PAIRS}
SELECT * REPLACE (group_id || ':' || turn * 60000 AS traj_id, turn * 60000 AS turn) FROM pairs""",
    "group_advantage": f"""WITH {TEXT}
SELECT traj_id, group_id, reward, {r6("full_advantage")} AS advantage FROM advantaged""",
    "event_advantage": f"""WITH rewarded AS (
  SELECT event_id AS traj_id, user_id AS group_id, value AS reward FROM events),
advantaged AS (SELECT *, {ADVANTAGE} AS advantage FROM rewarded WINDOW g AS (PARTITION BY group_id))
SELECT traj_id, group_id, {rounded(["reward", "advantage"])} FROM advantaged""",
    "origin_labelling": f"""WITH {TEXT}
SELECT traj_id, CASE WHEN full_advantage < 0 THEN 'negative' ELSE 'positive' END AS origin_label
FROM advantaged""",
    "vocabulary": f"""WITH named AS (SELECT doc_id AS traj_id, text FROM documents),
{words("named", ["text"])}, {vocabulary()}
SELECT word AS token, n, token_id FROM vocabulary""",
    "encode": f"""WITH {PAIRS}, {words("pairs", ["prompt", "response"])},
{vocabulary("WHERE field = 1")}, {coded("pairs")}
SELECT traj_id, {shown("p")} AS prompt_ids, {shown("r")} AS response_ids FROM coded""",
    "encode_repeated_ids": f"""WITH {PAIRS}, {words("pairs", ["prompt", "response"])},
{vocabulary("WHERE field = 1")}, {coded("pairs")}
SELECT CASE WHEN group_id % 5 <> 0 THEN group_id END AS group_id, {shown("p")} AS prompt_ids,
  {shown("r")} AS response_ids FROM coded JOIN pairs USING (traj_id)""",
    "truncate_keep_end": model_inputs(**LIMITS),
    "truncate_keep_start": model_inputs(**LIMITS, start=True),
    "labels_mask": model_inputs(bos=False),
    "completion_span": f"""WITH {text_tokens(**LIMITS)}, cells AS (
  SELECT traj_id, unnest(range(len(labels))) AS pos, unnest(labels) AS label FROM tokens)
SELECT traj_id, MIN(pos) FILTER (WHERE label <> -100) AS span_start,
  MAX(pos) FILTER (WHERE label <> -100) + 1 AS span_end FROM cells GROUP BY traj_id""",
    "truncation_audit": f"""WITH {text_tokens(**LIMITS)}
SELECT traj_id, response_len AS response_tokens, len(list_filter(labels, lambda x: x <> -100)) AS response_kept,
  CAST(len(list_filter(labels, lambda x: x <> -100)) < response_len AS BIGINT) AS response_cut FROM tokens""",
    "truncation_counts": f"""WITH {text_tokens(**LIMITS)},
kept AS (SELECT traj_id, response_len, len(list_filter(labels, lambda x: x <> -100)) AS k FROM tokens)
SELECT origin_label, COUNT(*) AS samples, COUNT(*) FILTER (WHERE k < response_len) AS responses_cut,
  CAST(SUM(response_len - k) AS BIGINT) AS tokens_lost
FROM kept JOIN trajectories USING (traj_id) GROUP BY origin_label""",
    "batch_assign": f"WITH {PAIRS}, {assignment('pairs', 'traj_id')} SELECT traj_id, {PLACE} FROM placed",
    "batch_assign_events": f"WITH {assignment('events', 'event_id')} SELECT event_id, {PLACE} FROM placed",
    "step_limit": f"""WITH {assignment("events", "event_id", per=1, procs=1, accum=1, epochs=1)}
SELECT event_id, {PLACE} FROM placed WHERE global_step < 5""",
    "step_limit_over_epochs": f"""WITH steps AS (SELECT CAST(ceil(COUNT(*) / 128.0E0) AS BIGINT) AS per FROM events),
passes AS (SELECT unnest(range((SELECT CAST(greatest(ceil(100.0E0 / per), 1) AS BIGINT) FROM steps))) AS epoch),
ordered AS (
  SELECT event_id, CAST(epoch AS INTEGER) AS epoch,
    ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || event_id)) - 1 AS position
  FROM events, passes),
placed AS (
  SELECT event_id, epoch, position, position // 16 AS batch_id, (position % 16) // 4 AS rank,
    position // 128 AS step_id, epoch * per + position // 128 AS global_step FROM ordered, steps)
SELECT event_id, {PLACE} FROM placed WHERE global_step < 100""",
    "pad_batches": f"""WITH {text_tokens()}, {assignment("tokens", "traj_id")},
sized AS (
  SELECT *, MAX(len(ids)) OVER (PARTITION BY epoch, batch_id, rank) AS m
  FROM tokens JOIN placed USING (traj_id))
SELECT traj_id, epoch, batch_id, rank, m AS batch_max_len,
  {shown("list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0))")} AS input_ids,
  {shown("list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - len(ids)), lambda x: 0))")} AS attention_mask,
  {shown("list_concat(labels, list_transform(range(m - len(ids)), lambda x: -100))")} AS labels FROM sized""",
    "batch_metrics": f"WITH {BATCH_METRICS} SELECT CAST(epoch AS BIGINT) AS epoch, * EXCLUDE (epoch) FROM per_batch",
    "step_metrics_last": f"""WITH {BATCH_METRICS},
last AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY epoch, step_id ORDER BY batch_id DESC) AS back
  FROM per_batch WHERE rank = 0)
SELECT CAST(epoch AS BIGINT) AS epoch, * EXCLUDE (epoch, back, rank) FROM last WHERE back = 1""",
    "preview": f"""WITH {text_tokens()}
SELECT md5('42:' || traj_id) AS preview_key, origin_label, {r6("nll_seq")} AS nll_seq,
  len(ids) AS input_length, {r6("-nll_seq")} AS log_mu
FROM trajectories JOIN tokens USING (traj_id) ORDER BY 1 LIMIT 3""",
    "unigram_policy": f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}
SELECT token, n FROM unigrams""",
    "bigram_policy": f"""WITH {text_tokens()}, {SCORED}, {BIGRAM}
SELECT prev, token, n FROM bigrams""",
    "weighted_policy": f"""WITH {text_tokens()}, {SCORED}
SELECT token, SUM(reward) AS n FROM scored JOIN trajectories USING (traj_id)
GROUP BY token HAVING SUM(reward) > 0""",
    "score_unigram": score("unigram_scores", UNIGRAM),
    "score_bigram": score("bigram_scores", BIGRAM),
    "token_scores": f"""WITH {text_tokens()}, {SCORED}, {BIGRAM}
SELECT traj_id, pos, token, {r6("token_logp")} AS token_logp FROM bigram_scores""",
    "sequence_nll": f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}, {sequences("sequences", "unigram_scores")}
SELECT traj_id, {r6("-policy_logps")} AS nll_seq FROM sequences""",
    "policy_metrics": f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}, {BIGRAM},
{sequences("behaviour", "unigram_scores")}, {sequences("target", "bigram_scores")},
rows AS (
  SELECT t.traj_id, t.advantage, t.origin_label, -b.policy_logps AS nll_seq, p.policy_logps, p.completion_len
  FROM trajectories t JOIN behaviour b USING (traj_id) JOIN target p USING (traj_id)),
{losses("rows")} SELECT origin_is_negative, {metric_list()} FROM losses GROUP BY origin_is_negative""",
    "policy_update": policy_update(),
    "policy_update_length_norm": policy_update(norm=True),
    "policy_training": f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}, {THETA},
{update_step(1, "theta_0")}, {update_step(2, "theta_1")}
SELECT CAST(token AS BIGINT) AS token, {r6("theta")} AS theta FROM theta_2""",
    "softmax_of_unigram": f"""WITH {text_tokens()}, {SCORED}, {UNIGRAM}
SELECT CAST(token_id AS BIGINT) AS token, {r6("ln(coalesce(n, 0.0E0) + 1)")} AS theta,
  {r6("ln((coalesce(n, 0.0E0) + 1) / (total + v))")} AS logp
FROM (SELECT token_id FROM vocabulary) LEFT JOIN unigrams ON token = token_id, size, mass""",
    "logits_softmax_gather": f"""WITH cells AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, {r6("MAX(x) FILTER (WHERE i = label) - ln(SUM(exp(x)))")} AS token_logp
FROM cells GROUP BY vec_id""",
    "logits_long": f"""WITH cells AS (
  SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
logits AS (SELECT vec_id AS traj_id, label, i // 8 - 2 + 1 AS pos, i % 8 AS candidate, x FROM cells)
SELECT traj_id, pos, MAX((label + pos) % 8) AS token,
  {r6("MAX(x) FILTER (WHERE candidate = (label + pos) % 8) - ln(SUM(exp(x)))")} AS token_logp
FROM logits WHERE pos BETWEEN 1 AND 5 GROUP BY traj_id, pos""",
    "logits_masked": """WITH cells AS (
  SELECT vec_id, vec_id % 8 AS label, unnest(range(8)) AS i, CAST(unnest(embedding[1:8]) AS DOUBLE) AS x FROM embeddings),
sums AS (SELECT vec_id, max(x) FILTER (WHERE i = label AND (vec_id + i) % 3 <> 0) AS own,
  ln(sum(exp(x)) FILTER (WHERE (vec_id + i) % 3 <> 0)) AS norm FROM cells GROUP BY vec_id)
SELECT vec_id, coalesce(printf('%.4f', own - norm), 'masked') AS array_form,
  coalesce(printf('%.4f', own - norm), 'masked') AS long_form FROM sums""",
    "encode_user_long_ids": """SELECT item_id, CASE WHEN item_id % 3 > 0 THEN item_id + 9007199254740993 END AS great,
  length(text) AS n, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) AS BIGINT) AS total FROM benchmark""",
    "user_encoder": f"""WITH {PAIRS},
coded AS (
  SELECT traj_id, list_transform(string_split(prompt, ''), lambda c: unicode(c)) AS p,
    list_transform(string_split(response, ''), lambda c: unicode(c)) AS r FROM pairs), {inputs(**LIMITS)}
SELECT traj_id, {shown("ids")} AS input_ids, {shown("labels")} AS labels FROM tokens""",
    "user_row_map": """SELECT doc_id, lang,
  CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS BIGINT) AS letters FROM documents""",
    "user_batch_function": f"""WITH {assignment("events", "event_id")}
SELECT CAST(epoch AS BIGINT) AS epoch, batch_id, COUNT(*) AS rows, {r6("SUM((position % 16 + 1) * value)", 4)} AS drift,
  arg_min(event_id, position) AS first_id
FROM placed JOIN events USING (event_id) GROUP BY epoch, batch_id""",
    "user_scorer": f"""WITH {text_tokens(**LIMITS)},
cells AS (
  SELECT traj_id, unnest(range(len(ids))) AS pos, unnest(ids) AS id, unnest(labels) AS label FROM tokens),
states AS (
  SELECT *, SUM(id) OVER (PARTITION BY traj_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM cells),
logits AS (
  SELECT traj_id, pos, label % 16 AS target, c, CAST((CAST(seen AS BIGINT) + 3 * c) % 7 AS DOUBLE) / 2.0E0 AS x
  FROM states, range(16) AS k(c) WHERE label <> -100 AND pos >= 1),
token_scores AS (
  SELECT traj_id, pos, MAX(target) AS token, MAX(x) FILTER (WHERE c = target) - ln(SUM(exp(x))) AS token_logp
  FROM logits GROUP BY traj_id, pos)
SELECT traj_id, pos, token, {r6("token_logp")} AS token_logp FROM token_scores""",
    "json_source": SOURCE,
    "json_inferred": ENRICHED,
    "json_long_ids": f"""SELECT event_id + 9007199254740993 AS traj_id, {r6("floor(value)")} AS nll_seq FROM events""",
    "parquet_mixed_folder": ENRICHED,
    "directory_with_card": SOURCE,
    "parquet_source": SOURCE,
    "directory_source": SOURCE + " WHERE advantage IS NOT NULL",
    "source_by_name": SOURCE.replace("SELECT traj_id", "SELECT 'test' AS split, traj_id") + " WHERE advantage IS NULL",
    "split_counts": f"""WITH {TEXT}
SELECT COUNT(advantage) AS train_samples, COUNT(*) - COUNT(advantage) AS eval_samples FROM trajectories""",
    "missing_label_source": f"""WITH {TEXT}
SELECT traj_id, CAST(NULL AS VARCHAR) AS origin_label, 0.0E0 AS origin_is_negative FROM trajectories""",
    "metrics_sink": f"""WITH {NUMERIC}, {losses("numbers", carry="origin_label,")}
SELECT CASE WHEN origin_label = 'negative' THEN 'eval' ELSE 'train' END AS split, {metric_list()}
FROM losses GROUP BY 1""",
    "training_set_sink": f"""WITH {text_tokens()}, {assignment("tokens", "traj_id")},
sized AS (
  SELECT *, MAX(len(ids)) OVER (PARTITION BY epoch, batch_id, rank) AS m
  FROM tokens JOIN placed USING (traj_id))
SELECT traj_id, CAST(epoch AS BIGINT) AS epoch, batch_id, rank, {r6("-nll_seq")} AS old_logps,
  {r6("coalesce(advantage, 1.0E0)")} AS advantage,
  CASE WHEN lower(trim(origin_label)) = 'negative' THEN 1.0E0 ELSE 0.0E0 END AS origin_is_negative,
  {shown("list_concat(ids, list_transform(range(m - len(ids)), lambda x: 0))")} AS input_ids,
  {shown("list_concat(labels, list_transform(range(m - len(ids)), lambda x: -100))")} AS labels
FROM sized JOIN trajectories USING (traj_id)""",
    "scoreboard": f"""SELECT lang AS benchmark, source AS model, COUNT(*) AS answers,
  {r6("AVG(CASE WHEN quality = 1 THEN 1.0E0 ELSE 0.0E0 END)")} AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang, source""",
    "stream_enrich": f"""WITH {EVENTS}, {losses("feed")}
SELECT traj_id, {rounded(["old_logps", *LOSS])}, CAST(capped AS BIGINT) AS capped FROM losses""",
    "stream_metrics": f"""WITH {EVENTS}, {losses("feed", carry="ts,")},
windowed AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM losses)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, {metric_list()}
FROM windowed GROUP BY window_start
HAVING window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
}
ORACLES["udtf_batches"] = ORACLES["user_batch_function"]
