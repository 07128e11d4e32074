"""The derived tables of ``plans.queries`` in SQL: named fragments that refer to each other, put together as needed."""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {
    "ev": """SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, event_id, event_type, value FROM events WHERE user_id IS NOT NULL""",
    "tot": "SELECT video_id, count(*) AS num_frames, min(t) AS t0, max(t) - min(t) AS duration FROM ev GROUP BY video_id",
    "kinds": "SELECT * FROM (VALUES (0, 'fixture', 60e0, 20e0), (1, 'bin', 45e0, 35e0), (2, 'part', 8e0, 8e0)) k(object_id, class_name, w, h)",
    "obj0": """SELECT *, NOT (event_type = 'error' AND (event_id + object_id) % 2 = 0) AS there,
      ((frame_idx + object_id * 8) // 24) * 12 + least((frame_idx + object_id * 8) % 24, 12) AS at_ FROM ev CROSS JOIN kinds""",
    "obj": """SELECT video_id, CAST(object_id AS BIGINT) AS object_id, frame_idx, class_name, CASE WHEN there THEN 0.5e0 + (event_id % 5) * 0.1e0 ELSE 0e0 END AS conf,
      CASE WHEN there THEN cx - w END AS x1, CASE WHEN there THEN cy - h END AS y1, CASE WHEN there THEN cx + w END AS x2, CASE WHEN there THEN cy + h END AS y2
      FROM (SELECT *, 200 + CAST(abs((at_ * 7 + object_id * 40) % 200 - 100) AS DOUBLE) AS cx, 150 + CAST(abs((at_ * 5 + object_id * 30) % 160 - 80) AS DOUBLE) AS cy FROM obj0)""",
    "pj0": "SELECT *, ((event_id + joint) % 10) / 10e0 AS conf FROM (SELECT video_id, frame_idx, event_id, unnest(range(17)) AS joint FROM ev)",
    "pj": """SELECT *, (x - 300) * 0.004e0 AS x3, (y - 250) * 0.004e0 AS y3 FROM (SELECT video_id, frame_idx, joint, conf, event_id,
      CASE WHEN conf > 0 THEN 180 + 6 * joint + CAST(abs((frame_idx * 9 + joint * 13) % 120 - 60) AS DOUBLE) END AS x,
      CASE WHEN conf > 0 THEN 100 + 14 * joint + CAST(abs((frame_idx * 4 + joint * 7) % 60 - 30) AS DOUBLE) END AS y,
      CASE WHEN conf > 0 THEN ((joint * 37) % 11 - 5) * 0.02e0 + (frame_idx % 7) * 0.01e0 END AS z3 FROM pj0)""",
    "lm": """SELECT video_id, frame_idx, 'right' AS side, landmark, 190 + CAST(abs((frame_idx * 8) % 200 - 100) AS DOUBLE) + (landmark % 5) * 6 AS x,
      150 + CAST(abs((frame_idx * 6) % 160 - 80) AS DOUBLE) + (landmark % 7) * 5 AS y, 0.5e0 + ((event_id + landmark) % 5) * 0.1e0 AS conf
      FROM (SELECT *, unnest(range(21)) AS landmark FROM ev WHERE event_type <> 'signup')""",
    "mot0": """SELECT *, sqrt((lead((x1 + x2) / 2) OVER w - (x1 + x2) / 2) * (lead((x1 + x2) / 2) OVER w - (x1 + x2) / 2) + (lead((y1 + y2) / 2) OVER w - (y1 + y2) / 2) * (lead((y1 + y2) / 2) OVER w - (y1 + y2) / 2)) AS step
      FROM obj WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame_idx)""",
    "mot": """SELECT video_id, object_id, frame_idx, class_name, conf, x1, y1, x2, y2, CASE WHEN x1 IS NOT NULL AND avg(step) OVER (PARTITION BY video_id, object_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) > 5
      THEN 'moving' ELSE 'static' END AS motion_state FROM mot0""",
    "sup": """SELECT a.*, CASE WHEN a.x1 IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM obj b WHERE b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND b.object_id <> a.object_id AND b.class_name = 'fixture'
      AND b.x1 IS NOT NULL AND b.x1 < (a.x1 + a.x2) / 2 AND (a.x1 + a.x2) / 2 < b.x2 AND abs(a.y2 - b.y1) < 20) THEN 'fixture' ELSE 'table' END AS support FROM mot a""",
    "cnt": """SELECT a.*, CASE WHEN a.x1 IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM obj b WHERE b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND b.object_id <> a.object_id AND b.class_name = 'bin'
      AND b.x1 IS NOT NULL AND b.x1 < (a.x1 + a.x2) / 2 AND (a.x1 + a.x2) / 2 < b.x2 AND b.y1 < (a.y1 + a.y2) / 2 AND (a.y1 + a.y2) / 2 < b.y2) THEN 'in_bin' ELSE 'none' END AS containment FROM sup a""",
    "hp0": """SELECT video_id, frame_idx, max(CASE WHEN joint = 9 AND ok THEN x END) AS lwx, max(CASE WHEN joint = 9 AND ok THEN y END) AS lwy, max(CASE WHEN joint = 7 AND ok THEN x END) AS lex, max(CASE WHEN joint = 7 AND ok THEN y END) AS ley,
      max(CASE WHEN joint = 10 AND ok THEN x END) AS rwx, max(CASE WHEN joint = 10 AND ok THEN y END) AS rwy, max(CASE WHEN joint = 8 AND ok THEN x END) AS rex, max(CASE WHEN joint = 8 AND ok THEN y END) AS rey
      FROM (SELECT *, conf >= 0.2e0 AND x IS NOT NULL AS ok FROM pj) GROUP BY video_id, frame_idx""",
    "hp": """SELECT * FROM (SELECT video_id, frame_idx, 'left' AS hand, CASE WHEN lex IS NOT NULL THEN lwx + 0.3e0 * (lwx - lex) ELSE lwx END AS hx, CASE WHEN ley IS NOT NULL THEN lwy + 0.3e0 * (lwy - ley) ELSE lwy END AS hy FROM hp0
      UNION ALL SELECT video_id, frame_idx, 'right', CASE WHEN rex IS NOT NULL THEN rwx + 0.3e0 * (rwx - rex) ELSE rwx END, CASE WHEN rey IS NOT NULL THEN rwy + 0.3e0 * (rwy - rey) ELSE rwy END FROM hp0) WHERE hx IS NOT NULL""",
    "near": """SELECT h.video_id, hand, object_id, h.frame_idx, sqrt((hx - greatest(x1, least(hx, x2))) * (hx - greatest(x1, least(hx, x2))) + (hy - greatest(y1, least(hy, y2))) * (hy - greatest(y1, least(hy, y2)))) AS distance
      FROM hp h JOIN mot o ON h.video_id = o.video_id AND h.frame_idx = o.frame_idx WHERE x1 IS NOT NULL""",
    "con0": """SELECT *, row_number() OVER (PARTITION BY video_id, hand, object_id, near_, run ORDER BY frame_idx) AS long_ FROM (SELECT *, i - row_number() OVER (PARTITION BY video_id, hand, object_id, near_ ORDER BY frame_idx) AS run
      FROM (SELECT *, distance < 50 AS near_, row_number() OVER (PARTITION BY video_id, hand, object_id ORDER BY frame_idx) AS i FROM near))""",
    "con": """SELECT video_id, hand, object_id, frame_idx, distance, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY video_id, hand, object_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_contact
      FROM (SELECT *, CASE WHEN near_ AND long_ >= 2 THEN true WHEN NOT near_ AND long_ >= 3 THEN false END AS signal FROM con0)""",
    "seg": """SELECT video_id, hand, object_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS n, avg(distance) AS mean_distance FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY video_id, hand, object_id ORDER BY frame_idx) AS run
      FROM con WHERE is_contact) GROUP BY video_id, hand, object_id, run""",
    "hstep": """SELECT video_id, CASE joint WHEN 9 THEN 'left' ELSE 'right' END AS hand, frame_idx, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) AS hand_step
      FROM pj WHERE joint IN (9, 10) WINDOW w AS (PARTITION BY video_id, joint ORDER BY frame_idx)""",
    "feat": """SELECT s.video_id, s.hand, s.object_id, s.frame_start, s.frame_end, s.frame_end - s.frame_start + 1 AS duration, coalesce(sum(hand_step), 0e0) AS hand_motion, coalesce(sum(step), 0e0) AS object_motion,
      CASE WHEN count(hand_step + step) >= 3 AND stddev_pop(CASE WHEN step IS NOT NULL THEN hand_step END) >= 1e-6 AND stddev_pop(CASE WHEN hand_step IS NOT NULL THEN step END) >= 1e-6
      THEN covar_pop(hand_step, step) / (stddev_pop(CASE WHEN step IS NOT NULL THEN hand_step END) * stddev_pop(CASE WHEN hand_step IS NOT NULL THEN step END)) ELSE 0e0 END AS correlation
      FROM seg s LEFT JOIN hstep h ON h.video_id = s.video_id AND h.hand = s.hand AND h.frame_idx >= s.frame_start AND h.frame_idx < s.frame_end
      LEFT JOIN mot0 o ON o.video_id = s.video_id AND o.object_id = s.object_id AND o.frame_idx = h.frame_idx GROUP BY ALL""",
    "inter": """SELECT f.*, CASE WHEN duration >= 5 AND correlation > 0.7e0 AND object_motion > 5 * duration * 0.5e0 THEN 'grasp' WHEN a.containment = 'none' AND b.containment = 'in_bin' THEN 'insert' WHEN a.containment = 'in_bin' AND b.containment = 'none' THEN 'remove'
      WHEN object_motion > 5 * duration AND correlation < 0.7e0 AND duration >= 3 THEN 'push' WHEN duration < 5 THEN 'touch' ELSE 'unknown' END AS label,
      CASE WHEN duration >= 5 AND correlation > 0.7e0 AND object_motion > 5 * duration * 0.5e0 THEN least(0.9e0, 0.5e0 + 0.4e0 * correlation) WHEN a.containment = 'none' AND b.containment = 'in_bin' THEN 0.8e0 WHEN a.containment = 'in_bin' AND b.containment = 'none' THEN 0.8e0
      WHEN object_motion > 5 * duration AND correlation < 0.7e0 AND duration >= 3 THEN 0.6e0 WHEN duration < 5 THEN 0.5e0 ELSE 0.3e0 END AS confidence
      FROM feat f LEFT JOIN cnt a ON a.video_id = f.video_id AND a.object_id = f.object_id AND a.frame_idx = f.frame_start LEFT JOIN cnt b ON b.video_id = f.video_id AND b.object_id = f.object_id AND b.frame_idx = f.frame_end""",
    "mrg": """SELECT video_id, hand, object_id, label, min(frame_start) AS frame_start, max(frame_end) AS frame_end, count(*) AS parts, arg_min(duration, frame_start) AS first_duration, arg_min(hand_motion, frame_start) AS first_hand, arg_min(object_motion, frame_start) AS first_object, arg_min(correlation, frame_start) AS first_corr, list_reduce(list(confidence ORDER BY frame_start), lambda x, y: (x + y) / 2) AS confidence
      FROM (SELECT *, sum(new) OVER (PARTITION BY video_id, hand, object_id, label ORDER BY frame_start) AS g FROM (SELECT *, coalesce(CAST(frame_start - max(frame_end) OVER (PARTITION BY video_id, hand, object_id, label ORDER BY frame_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 > 5 AS INTEGER), 1) AS new FROM inter))
      GROUP BY video_id, hand, object_id, label, g""",
    "evt": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_start, hand, object_id, label) - 1 AS event_id FROM mrg WHERE confidence >= 0.3e0 AND frame_end - frame_start + 1 >= 3""",
    "grasp": "SELECT DISTINCT video_id, object_id, unnest(range(frame_start, frame_end + 1)) AS frame_idx FROM evt WHERE label = 'grasp'",
    "st": """SELECT a.video_id, a.object_id, a.frame_idx, a.class_name, a.x1, a.motion_state, CASE WHEN g.video_id IS NOT NULL THEN 'hand' ELSE a.support END AS support_relation,
      CASE WHEN g.video_id IS NOT NULL THEN 'grasped' WHEN c.video_id IS NOT NULL THEN 'in_contact' ELSE 'none' END AS interaction_state, a.containment
      FROM cnt a LEFT JOIN (SELECT DISTINCT video_id, object_id, frame_idx FROM con WHERE is_contact) c ON c.video_id = a.video_id AND c.object_id = a.object_id AND c.frame_idx = a.frame_idx
      LEFT JOIN grasp g ON g.video_id = a.video_id AND g.object_id = a.object_id AND g.frame_idx = a.frame_idx""",
    "lag1": """SELECT *, lag(motion_state) OVER w AS pm, lag(support_relation) OVER w AS ps, lag(interaction_state) OVER w AS pi, lag(containment) OVER w AS pc FROM st WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame_idx)""",
    "chg": """SELECT video_id, object_id, frame_idx, 'motion_state' AS dimension, pm AS "from", motion_state AS "to" FROM lag1 WHERE pm <> motion_state UNION ALL SELECT video_id, object_id, frame_idx, 'support_relation', ps, support_relation FROM lag1 WHERE ps <> support_relation
      UNION ALL SELECT video_id, object_id, frame_idx, 'interaction_state', pi, interaction_state FROM lag1 WHERE pi <> interaction_state UNION ALL SELECT video_id, object_id, frame_idx, 'containment', pc, containment FROM lag1 WHERE pc <> containment""",
    "bnd0": """SELECT video_id, frame_start AS frame_idx, 'contact_onset' AS trigger, object_id, confidence, 0 AS rank, event_id * 2 AS seq, event_id, label, hand, CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS VARCHAR) AS now FROM evt
      UNION ALL SELECT video_id, frame_end + 1, 'contact_offset', object_id, confidence, 0, event_id * 2 + 1, event_id, label, hand, NULL, NULL, NULL FROM evt
      UNION ALL SELECT video_id, frame_idx, CASE dimension WHEN 'motion_state' THEN CASE "to" WHEN 'moving' THEN 'motion_start' ELSE 'motion_stop' END WHEN 'support_relation' THEN 'support_change' ELSE 'containment_change' END, object_id,
      CASE dimension WHEN 'motion_state' THEN 0.7e0 WHEN 'support_relation' THEN 0.8e0 ELSE 0.85e0 END, CASE dimension WHEN 'motion_state' THEN 1 WHEN 'support_relation' THEN 2 ELSE 3 END, object_id, NULL, NULL, NULL, dimension, "from", "to" FROM chg WHERE dimension <> 'interaction_state'""",
    "bnd": """SELECT b.video_id, b.frame_idx, arg_min(trigger, CAST(rank AS BIGINT) * 1000000000 + seq) AS trigger, max(confidence) AS confidence, list_sort(list(DISTINCT b.object_id)) AS objects, arg_max(event_id, seq) FILTER (rank = 0) AS event_id, arg_max(label, seq) FILTER (rank = 0) AS label,
      arg_max(hand, seq) FILTER (rank = 0) AS hand, arg_max(b.object_id, CAST(rank AS BIGINT) * 1000000000 + seq) FILTER (rank > 0) AS object_id, arg_max(was, seq) FILTER (rank = 1) AS prev_state, arg_max(now, seq) FILTER (rank = 1) AS curr_state,
      arg_max(was, seq) FILTER (rank = 2) AS prev_support, arg_max(now, seq) FILTER (rank = 2) AS curr_support, arg_max(was, seq) FILTER (rank = 3) AS prev_containment, arg_max(now, seq) FILTER (rank = 3) AS curr_containment FROM bnd0 b GROUP BY b.video_id, b.frame_idx""",
    "cut": """SELECT b.video_id, frame_idx AS frame_start, coalesce(lead(frame_idx) OVER (PARTITION BY b.video_id ORDER BY frame_idx) - 1, num_frames - 1) AS frame_end, confidence, objects, trigger FROM bnd b JOIN tot ON tot.video_id = b.video_id WHERE frame_idx < num_frames""",
    "sg0": """SELECT * FROM cut WHERE frame_end - frame_start + 1 >= 2 UNION ALL SELECT video_id, 0, min(frame_start) - 1, 0.5e0, [], 'video_start' FROM cut GROUP BY video_id HAVING min(frame_start) > 0
      UNION ALL SELECT video_id, 0, num_frames - 1, 0.5e0, [], 'no_boundaries' FROM tot WHERE video_id NOT IN (SELECT video_id FROM cut)""",
    "sg": """SELECT s.*, row_number() OVER (PARTITION BY s.video_id ORDER BY frame_start) - 1 AS seg_id, a.t AS t_start, b.t AS t_end FROM sg0 s LEFT JOIN ev a ON a.video_id = s.video_id AND a.frame_idx = frame_start LEFT JOIN ev b ON b.video_id = s.video_id AND b.frame_idx = frame_end""",
    "cl0": """SELECT *, CASE WHEN nxt - frame_end - 1 <> 0 THEN (frame_end + nxt) // 2 END AS mid FROM (SELECT *, lead(frame_start) OVER (PARTITION BY video_id ORDER BY frame_start) AS nxt FROM sg)""",
    "cl1": """SELECT video_id, seg_id, coalesce(before + 1, frame_start) AS frame_start, coalesce(mid, frame_end) AS frame_end, confidence, objects, t_start, t_end, mid, before FROM (SELECT *, lag(mid) OVER (PARTITION BY video_id ORDER BY frame_start) AS before FROM cl0)""",
    "cl2": """SELECT video_id, seg_id, t_start AS a, CASE WHEN mid IS NOT NULL THEN t_start + (mid - frame_start) / 30e0 ELSE t_end END AS b FROM cl1 WHERE seg_id = 0
      UNION ALL SELECT c.video_id, c.seg_id, CASE WHEN before IS NOT NULL THEN r.b ELSE t_start END, CASE WHEN mid IS NOT NULL THEN CASE WHEN before IS NOT NULL THEN r.b ELSE t_start END + (mid - frame_start) / 30e0 ELSE t_end END
      FROM cl2 r JOIN cl1 c ON c.video_id = r.video_id AND c.seg_id = r.seg_id + 1""",
    "cl": "SELECT c.video_id, c.seg_id, frame_start, frame_end, confidence, objects, a AS t_start, b AS t_end FROM cl1 c JOIN cl2 r ON r.video_id = c.video_id AND r.seg_id = c.seg_id",
    "sev": "SELECT s.video_id, seg_id, event_id, e.label AS event_label FROM cl s JOIN evt e ON e.video_id = s.video_id AND e.frame_end >= s.frame_start AND e.frame_start <= s.frame_end",
    "sobj": "SELECT video_id, seg_id, frame_start, frame_end, unnest(objects) AS object_id FROM cl",
    "sch0": """SELECT s.video_id, s.seg_id, s.object_id, a.support_relation AS s0, b.support_relation AS s1, a.motion_state AS m0, b.motion_state AS m1, a.containment AS c0, b.containment AS c1, a.interaction_state AS i0, b.interaction_state AS i1
      FROM sobj s JOIN st a ON a.video_id = s.video_id AND a.object_id = s.object_id AND a.frame_idx = s.frame_start JOIN st b ON b.video_id = s.video_id AND b.object_id = s.object_id AND b.frame_idx = s.frame_end""",
    "sch": """SELECT video_id, seg_id, object_id, 'support_relation' AS dimension, s0 AS "from", s1 AS "to" FROM sch0 WHERE s0 <> s1 UNION ALL SELECT video_id, seg_id, object_id, 'motion_state', m0, m1 FROM sch0 WHERE m0 <> m1
      UNION ALL SELECT video_id, seg_id, object_id, 'containment', c0, c1 FROM sch0 WHERE c0 <> c1 UNION ALL SELECT video_id, seg_id, object_id, 'interaction_state', i0, i1 FROM sch0 WHERE i0 <> i1""",
    "pat": """SELECT s.video_id, s.seg_id, (SELECT count(*) FROM sev e WHERE e.video_id = s.video_id AND e.seg_id = s.seg_id) AS num_events, (SELECT count(*) FROM sch c WHERE c.video_id = s.video_id AND c.seg_id = s.seg_id) AS num_changes,
      coalesce((SELECT list(DISTINCT event_label) FROM sev e WHERE e.video_id = s.video_id AND e.seg_id = s.seg_id), []) AS e,
      coalesce((SELECT list(DISTINCT dimension || ':' || "from" || ':' || "to") FROM sch c WHERE c.video_id = s.video_id AND c.seg_id = s.seg_id), []) AS c FROM cl s""",
    "lab": """SELECT video_id, seg_id, num_events, num_changes, e, c, CASE
      WHEN list_contains(e, 'grasp') AND list_has_any(c, ['support_relation:table:hand', 'support_relation:fixture:hand', 'support_relation:unknown:hand']) THEN 'pick' WHEN list_contains(e, 'grasp') AND list_has_any(c, ['support_relation:hand:table', 'support_relation:hand:fixture']) THEN 'place'
      WHEN list_has_any(c, ['containment:none:in_bin', 'containment:unknown:in_bin']) THEN 'insert' WHEN list_contains(c, 'containment:in_bin:none') THEN 'remove' WHEN list_contains(e, 'push') THEN 'push' WHEN list_contains(e, 'pull') THEN 'pull'
      WHEN list_contains(e, 'touch') AND num_changes = 0 THEN 'inspect' WHEN list_contains(c, 'motion_state:static:moving') AND num_events = 0 THEN 'reach' WHEN list_contains(c, 'motion_state:moving:static') AND num_events > 0 THEN 'retract'
      WHEN list_contains(e, 'grasp') AND list_has_any(c, ['motion_state:static:moving', 'motion_state:moving:static']) AND len(list_filter(c, lambda x: starts_with(x, 'support_relation'))) = 0 THEN 'manipulate'
      WHEN num_events = 0 AND num_changes = 0 THEN 'idle' WHEN num_events > 0 THEN 'manipulate' ELSE 'unknown' END AS label FROM pat""",
    "pre": """SELECT s.video_id, s.seg_id, s.object_id, motion_state, support_relation, interaction_state, containment FROM sobj s JOIN st ON st.video_id = s.video_id AND st.object_id = s.object_id AND st.frame_idx = greatest(0, s.frame_start - 1)""",
    "post": """SELECT s.video_id, s.seg_id, s.object_id, b.motion_state, b.support_relation, b.interaction_state, b.containment, CAST(a.motion_state <> b.motion_state AS BIGINT) + CAST(a.support_relation <> b.support_relation AS BIGINT) + CAST(a.interaction_state <> b.interaction_state AS BIGINT) + CAST(a.containment <> b.containment AS BIGINT) AS num_changes
      FROM sobj s JOIN tot ON tot.video_id = s.video_id JOIN st a ON a.video_id = s.video_id AND a.object_id = s.object_id AND a.frame_idx = s.frame_start JOIN st b ON b.video_id = s.video_id AND b.object_id = s.object_id AND b.frame_idx = least(s.frame_end + 1, num_frames - 1)""",
    "prs": """SELECT a.video_id, a.seg_id AS source, b.seg_id AS target, list_intersect(a.objects, b.objects) AS shared FROM cl a JOIN cl b ON a.video_id = b.video_id AND a.frame_end < b.frame_start WHERE list_has_any(a.objects, b.objects)""",
    "cau": """SELECT p.video_id, source, target, least(1e0, (count(*) * 0.8e0 + sum(CASE WHEN num_changes > 0 THEN 1 ELSE 0 END) * 0.1e0) / greatest(1, max(len(shared)))) AS confidence, count(*) AS num_matched, max(len(shared)) AS num_shared FROM (SELECT *, unnest(shared) AS object_id FROM prs) p
      JOIN post a ON a.video_id = p.video_id AND a.seg_id = source AND a.object_id = p.object_id JOIN pre b ON b.video_id = p.video_id AND b.seg_id = target AND b.object_id = p.object_id
      WHERE a.motion_state = b.motion_state AND a.support_relation = b.support_relation AND a.interaction_state = b.interaction_state AND a.containment = b.containment GROUP BY p.video_id, source, target
      HAVING least(1e0, (count(*) * 0.8e0 + sum(CASE WHEN num_changes > 0 THEN 1 ELSE 0 END) * 0.1e0) / greatest(1, max(len(shared)))) >= 0.5e0""",
    "tmp": """SELECT n.* FROM (SELECT video_id, seg_id AS source, lead(seg_id) OVER w AS target, lead(frame_start) OVER w - frame_end AS gap_frames FROM cl WINDOW w AS (PARTITION BY video_id ORDER BY frame_start, seg_id)) n
      WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cau c WHERE c.video_id = n.video_id AND c.source = n.source AND c.target = n.target)""",
    "edg": "SELECT video_id, source, target, 'causal' AS edge_type, confidence FROM cau UNION ALL SELECT video_id, source, target, 'temporal', 0.5e0 FROM tmp",
    "fit0": "SELECT *, joint IN (5, 6, 11, 12) AS torso FROM pj WHERE conf > 0.2e0 AND x3 IS NOT NULL AND x >= 0 AND y >= 0",
    "fit": """SELECT video_id, frame_idx, s AS scale, mx3 - s * mx AS tx, my3 - s * my AS ty, coalesce(z, 0e0) AS z_plane FROM (SELECT video_id, frame_idx, count(*) AS n, (covar_pop(x, x3) + covar_pop(y, y3)) / (var_pop(x) + var_pop(y)) AS s, avg(x) AS mx, avg(y) AS my, avg(x3) AS mx3, avg(y3) AS my3,
      avg(CASE WHEN torso THEN z3 END) AS z FROM fit0 GROUP BY video_id, frame_idx) WHERE n >= 3""",
    "tip": """SELECT video_id, frame_idx, side, object_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, CASE WHEN least_ < 30 OR inside >= 1 THEN tip_x END AS touch_x, CASE WHEN least_ < 30 OR inside >= 1 THEN tip_y END AS touch_y, least_ < 30 OR inside >= 1 OR pd < 21 AS is_contact, (near_ >= 2 OR inside >= 2 OR (pd = 0 AND near_ >= 1)) AND score > 0.35e0 AS is_grab,
  round(CASE WHEN (near_ >= 2 OR inside >= 2 OR (pd = 0 AND near_ >= 1)) AND score > 0.35e0 THEN score ELSE 0 END, 6) AS grab_confidence FROM (SELECT *, least(w / 2.5e0, 1e0) * 0.4e0 + greatest(0, 1 - pinch / 100) * 0.3e0 + greatest(0, 1 - pd / 50) * 0.3e0 AS score FROM (
  SELECT t.*, pinch, sqrt((px - greatest(x1, least(px, x2))) ** 2 + (py - greatest(y1, least(py, y2))) ** 2) AS pd FROM (SELECT l.video_id, l.frame_idx, l.side, l.object_id, x1, y1, x2, y2, min(d) AS least_, arg_min(x, (d, landmark)) AS tip_x, arg_min(y, (d, landmark)) AS tip_y, count(*) FILTER (d < 30) AS near_, count(*) FILTER (d = 0) AS inside,
  sum(CASE WHEN d < 30 THEN conf ELSE 0 END + CASE WHEN d = 0 THEN 0.5e0 * conf ELSE 0 END) AS w FROM (SELECT a.video_id, a.frame_idx, side, object_id, a.conf, a.x, a.y, landmark, x1, y1, x2, y2, sqrt((x - greatest(x1, least(x, x2))) ** 2 + (y - greatest(y1, least(y, y2))) ** 2) AS d
  FROM lm a JOIN obj o ON a.video_id = o.video_id AND a.frame_idx = o.frame_idx WHERE x1 IS NOT NULL AND landmark IN (4, 8, 12, 16, 20)) l GROUP BY ALL) t
  JOIN (SELECT video_id, frame_idx, side, avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN x END) AS px, avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN y END) AS py,
  sqrt((max(CASE WHEN landmark = 4 THEN x END) - max(CASE WHEN landmark = 8 THEN x END)) ** 2 + (max(CASE WHEN landmark = 4 THEN y END) - max(CASE WHEN landmark = 8 THEN y END)) ** 2) AS pinch FROM lm GROUP BY ALL) h ON h.video_id = t.video_id AND h.frame_idx = t.frame_idx AND h.side = t.side))""",
    "hnd": "SELECT video_id, side, frame_idx, row_number() OVER (PARTITION BY video_id, side ORDER BY frame_idx) AS i FROM (SELECT DISTINCT video_id, side, frame_idx FROM lm)",
    "tou": """SELECT t.*, i, min(CASE WHEN is_contact THEN i END) OVER (PARTITION BY t.video_id, t.side, object_id ORDER BY i) AS first_, sum(CAST(is_contact AS INTEGER)) OVER (PARTITION BY t.video_id, t.side, object_id ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS held
      FROM tip t JOIN hnd h ON h.video_id = t.video_id AND h.side = t.side AND h.frame_idx = t.frame_idx""",
    "gri": """SELECT video_id, side, frame_idx, g, gc, sum(CAST(g AS INTEGER)) OVER b > 0.5e0 * count(*) OVER b AS holds FROM (SELECT h.video_id, h.side, h.frame_idx, i, coalesce(bool_or(is_grab), false) AS g, coalesce(max(grab_confidence), 0e0) AS gc
      FROM hnd h LEFT JOIN tip t ON h.video_id = t.video_id AND h.side = t.side AND h.frame_idx = t.frame_idx GROUP BY ALL) WINDOW b AS (PARTITION BY video_id, side ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "smo": """SELECT *, CASE WHEN contact AND NOT is_contact THEN cx END AS contact_x, CASE WHEN contact AND NOT is_contact THEN cy END AS contact_y FROM (SELECT t.video_id, t.frame_idx, t.side, object_id, cx, cy, is_contact,
      is_contact OR coalesce(held > 0.4e0 * least(5, i - first_ + 1), false) AS contact, g OR holds AS grabs, CASE WHEN holds THEN greatest(gc, 0.5e0) ELSE gc END AS grab_confidence
      FROM tou t JOIN gri g ON g.video_id = t.video_id AND g.side = t.side AND g.frame_idx = t.frame_idx)""",
}


def _named(name: str, parts: list[str]) -> str:
    return ", ".join(f"{e} AS {name}_{c}" for c, e in zip("xyz", parts, strict=True))


def _of(name: str) -> list[str]:
    return [f"{name}_{c}" for c in "xyz"]


def _minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def _unit(a: list[str]) -> list[str]:
    return [f"{x} / (sqrt({_dot(a, a)}) + 1e-8)" for x in a]


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _case(cases: list[tuple[str, list[str]]], other: list[str]) -> list[str]:
    return ["CASE " + " ".join(f"WHEN {w} THEN {v[i]}" for w, v in cases) + f" ELSE {other[i]} END" for i in range(3)]


def _middle(name: str) -> list[str]:
    return [f"((l{name}_{c} + r{name}_{c}) * 0.5e0)" for c in "xyz"]


_JOINTS = {"nose": 0, "leye": 1, "reye": 2, "lear": 3, "rear": 4, "lsho": 5, "rsho": 6}
_BOTH = {n: f"(l{n}_c > 0.3e0 AND l{n}_x IS NOT NULL AND r{n}_c > 0.3e0 AND r{n}_x IS NOT NULL)" for n in ("eye", "ear", "sho")}
_NOSE, _C, _S = "(nose_c > 0.3e0 AND nose_x IS NOT NULL)", "cos(radians(30e0))", "sin(radians(30e0))"
_ACROSS = {n: _unit(_minus(_of(f"r{n}"), _of(f"l{n}"))) for n in ("ear", "sho")}
_SEEN = _minus(["p.px", "p.py", "p.pz"], [f"h.eye_{c}" for c in "xyz"])


def seen(points: str) -> str:
    """Rows with px, py and pz, and these in the head's frame."""
    parts = {"ex": _dot(_SEEN, [f"h.right_{c}" for c in "xyz"]), "ey": "-" + _dot(_SEEN, [f"h.up_{c}" for c in "xyz"]), "ez": _dot(_SEEN, [f"h.forward_{c}" for c in "xyz"])}
    return f"SELECT p.*, {', '.join(f'{e} AS {n}' for n, e in parts.items())} FROM {points} p JOIN head h ON h.video_id = p.video_id AND h.frame_idx = p.frame_idx"


FRAGMENTS |= {
    "hw": "SELECT video_id, frame_idx, " + ", ".join(f"max(CASE WHEN joint = {j} THEN {v} END) AS {n}_{c}" for n, j in _JOINTS.items() for c, v in (("x", "x3"), ("y", "y3"), ("z", "z3")))
    + ", " + ", ".join(f"coalesce(max(CASE WHEN joint = {j} THEN conf END), 0e0) AS {n}_c" for n, j in _JOINTS.items()) + " FROM pj GROUP BY video_id, frame_idx",
    "h0": f"SELECT *, {_BOTH['eye']} AS eyes, {_BOTH['ear']} AS ears, {_NOSE} AS nose, {_BOTH['sho']} AS sho FROM hw",
    "h1": f"""SELECT *, NOT (eyes OR ears OR nose OR sho) AS nothing, CASE WHEN eyes THEN (leye_c + reye_c) / 2 WHEN ears THEN (lear_c + rear_c) / 2 WHEN nose THEN nose_c WHEN sho THEN 0.3e0 ELSE 0e0 END AS confidence,
      {_named("h", _case([("eyes", _middle("eye")), ("ears", _middle("ear")), ("nose", _of("nose")), ("sho", [_middle("sho")[0], f"({_middle('sho')[1]} - 0.25e0)", _middle("sho")[2]])], ["0e0"] * 3))},
      {_named("a", _case([("ears", _ACROSS["ear"]), ("sho", _ACROSS["sho"])], ["1e0", "0e0", "0e0"]))} FROM h0""",
    "h2": f"SELECT *, {_named('u', _case([('sho', _unit(_minus(_of('h'), _middle('sho'))))], ['0e0', '-1e0', '0e0']))} FROM h1",
    "h3": f"SELECT *, {_named('f', _unit(_cross(_of('u'), _of('a'))))} FROM h2",
    "h4": f"SELECT *, {_named('r', _unit(_cross(_of('f'), _of('u'))))} FROM h3",
    "h5": f"""SELECT *, {_named("forward", _case([("nothing", ["0e0", "0e0", "1e0"])], [f"{f} * {_C} - {u} * {_S}" for f, u in zip(_of("f"), _of("u"), strict=True)]))},
      {_named("up", _case([("nothing", ["0e0", "-1e0", "0e0"])], [f"{f} * {_S} + {u} * {_C}" for f, u in zip(_of("f"), _of("u"), strict=True)]))}, {_named("right", _case([("nothing", ["1e0", "0e0", "0e0"])], _of("r")))} FROM h4""",
    "head": f"SELECT *, {_named('eye', _case([('nothing', ['0e0'] * 3)], [f'h_{c} + forward_{c} * 0.1e0' for c in 'xyz']))} FROM h5",
    "bod0": """SELECT video_id, frame_idx, max(CASE WHEN joint = 5 AND conf > 0.3e0 THEN x END) AS lx, max(CASE WHEN joint = 5 AND conf > 0.3e0 THEN y END) AS ly, max(CASE WHEN joint = 6 AND conf > 0.3e0 THEN x END) AS sx, max(CASE WHEN joint = 6 AND conf > 0.3e0 THEN y END) AS sy FROM pj GROUP BY video_id, frame_idx""",
    "bod1": "SELECT *, lx IS NOT NULL AND sx IS NOT NULL AS ok, CASE WHEN lx IS NOT NULL AND sx IS NOT NULL THEN sqrt((sx - lx) ** 2 + (sy - ly) ** 2) ELSE 0e0 END AS l FROM bod0",
    "bod": """SELECT video_id, frame_idx, CASE WHEN ok THEN (lx + sx) / 2 ELSE 320e0 END AS cx, CASE WHEN ok THEN (ly + sy) / 2 ELSE 240e0 END AS cy, CASE WHEN l > 10 THEN (sx - lx) / l ELSE 1e0 END AS rx, CASE WHEN l > 10 THEN (sy - ly) / l ELSE 0e0 END AS ry,
      CASE WHEN l > 10 THEN -(sy - ly) / l ELSE 0e0 END AS fx, CASE WHEN l > 10 THEN (sx - lx) / l ELSE -1e0 END AS fy, CASE WHEN l < 10 THEN 192e0 ELSE l END AS wide FROM bod1""",
    "op": """SELECT o.video_id, o.frame_idx, object_id, scale * (x1 + x2) / 2 + tx AS px, scale * (y1 + y2) / 2 + ty AS py, z_plane AS pz FROM obj o JOIN fit ON fit.video_id = o.video_id AND fit.frame_idx = o.frame_idx WHERE x1 IS NOT NULL""",
    "eo": seen("op"),
    "anc": """SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY d, side) AS r FROM (SELECT l.video_id, l.frame_idx, CASE p.joint WHEN 9 THEN 'left' ELSE 'right' END AS side, scale, p.x3, p.y3, p.z3, sqrt((l.x - p.x) ** 2 + (l.y - p.y) ** 2) AS d, l.x AS x0, l.y AS y0
      FROM lm l JOIN pj p ON p.video_id = l.video_id AND p.frame_idx = l.frame_idx JOIN fit ON fit.video_id = l.video_id AND fit.frame_idx = l.frame_idx WHERE l.landmark = 0 AND p.joint IN (9, 10) AND p.conf > 0.2e0 AND p.x >= 0)""",
    "mrk": """SELECT a.video_id, a.frame_idx, a.side, landmark, a.x3 + (l.x - x0) * scale AS px, a.y3 + (l.y - y0) * scale AS py, a.z3 AS pz FROM anc a JOIN lm l ON l.video_id = a.video_id AND l.frame_idx = a.frame_idx WHERE r = 1""",
    "em": seen("mrk"),
    "arm": """SELECT * FROM (SELECT video_id, frame_idx, CASE WHEN joint IN (5, 7, 9) THEN 'left' ELSE 'right' END AS side, (joint - 5) // 2 AS part, x3 AS px, y3 AS py, z3 AS pz, count(*) OVER (PARTITION BY video_id, frame_idx, joint % 2) AS k
      FROM pj WHERE joint BETWEEN 5 AND 10 AND conf > 0.3e0 AND x3 IS NOT NULL) WHERE k = 3""",
    "ea": seen("arm"),
}


def sql(body: str, once: tuple[str, ...] = ()) -> str:
    """The statement with the fragments that it needs before it; those in ``once`` are computed once, however often they are read."""
    order: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+(\w+)", text) + re.findall(r"\bCROSS JOIN (\w+)", text):
            if name in FRAGMENTS and name not in order and name != inside:
                need(FRAGMENTS[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in once else ''}({FRAGMENTS[n]})" for n in order) + " " + body if order else body
