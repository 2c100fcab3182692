"""tidepool: event-stream operators on Spark DataFrames, batch and streaming.

Every operator is a ``DataFrame -> DataFrame`` function (use it with
``df.transform``) built from Spark SQL expressions; keyed state in streams is
kept by Structured Streaming's ``transformWithState``.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Python code that runs inside tasks (mapInArrow scans, pandas UDFs,
# stateful processors) is shipped with the task by value, so executors need
# no installed copy of this package and no staged files.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

# The public operators, importable from the package root.
from tidepool.functions.parse import (first_word_more, game_event_fields,  # noqa: E402,F401
                                      game_event_rejects, parse_game_event, parse_json_payload,
                                      split_ws, strip_ws)
from tidepool.functions.scalar import (as_float, as_int, as_str, assign_event_time,  # noqa: E402,F401
                                       decode_utf8, encode_bytes, end_of_time, format_pair,
                                       format_score, is_end_of_time, key_by, multiply, now_iso,
                                       path_join, random_value, split_tokens, timestamp_text,
                                       value_range, with_event_time)
from tidepool.functions.rows import flat_map  # noqa: E402,F401
from tidepool.operators.align import flatten, sync, sync_tagged  # noqa: E402,F401
from tidepool.operators.combine import Combiner, combine_by_key  # noqa: E402,F401
from tidepool.operators.completion import (job_output, job_output_all_levels,  # noqa: E402,F401
                                           job_output_and_rest, job_output_rows)
from tidepool.operators.ordered import number_rows, number_sessions  # noqa: E402,F401
from tidepool.operators.route import (attribute_predicate, count_where,  # noqa: E402,F401
                                      dead_letter, dead_letter_expr, errors, fail_on_value,
                                      fan_out, filter_by_attributes, retry_call, routes,
                                      row_budget_guard, split_threshold, tap, tap_sample)
from tidepool.operators.scores import (group_values, merge_sorted,  # noqa: E402,F401
                                       scores_by_field, total_score, user_score)
from tidepool.operators.sessions import (assign_sessions, fixed_windows,  # noqa: E402,F401
                                         session_windows, sessions_with_final,
                                         to_global_window)
from tidepool.operators.windows import (assign_merged_windows,  # noqa: E402,F401
                                        merged_windows)
from tidepool.session import build_session, checkpoint_root  # noqa: E402,F401
