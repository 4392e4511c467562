"""Driver-side plans: recipes, feature rounds, cleaning passes and benchmark runs. They build lazy frames."""
