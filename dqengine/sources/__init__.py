"""Where data, states and metrics come from and go to."""
