"""Training-data operators: each module holds one operator; ``queries`` registers the thin opN queries."""
