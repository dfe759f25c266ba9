"""DataFrame operators: joins, sequences, profiles, matching, planning, arrangement, grading."""
