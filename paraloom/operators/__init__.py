"""DataFrame operators: statistics, candidates, pairs, cleaning, terms, matching, evaluation."""
