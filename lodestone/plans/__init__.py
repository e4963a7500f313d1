"""What plans do: for tests and tuning."""
