"""Physical patterns shared by the operators: prefix sums, segments, salted joins."""
