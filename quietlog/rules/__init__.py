"""Readers of detection rules. Each gives requirements (what a rule may read, never too little) and, for Sigma, exact rules to evaluate."""
