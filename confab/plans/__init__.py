"""confab.plans"""
