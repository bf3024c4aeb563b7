"""Planning operators: upgrades, rollouts and drift."""
